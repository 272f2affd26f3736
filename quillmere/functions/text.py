"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that the comparison of requests leaves out.
PUNCTUATION = "，。？！、：;“”\"'()（）,.?!%"
CJK = "[一-鿿]"


def strip_space(c: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def normalize_request(c: Column) -> Column:
    """White space out, every run of ASCII digits as #, then the fixed punctuation out."""
    return F.translate(F.regexp_replace(strip_space(c), "[0-9]+", "#"), PUNCTUATION, "")


def normalize_words(c: Column) -> Column:
    """Letters, digits and underscores only, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))


def bigrams(c: Column) -> Column:
    """Distinct pieces of two characters without white space; an empty array for shorter texts.

    The characters are split once and bound to a variable, so the time is linear in the length of the text.
    """
    none = F.array().cast("array<string>")
    letters = F.regexp_extract_all(strip_space(c), F.lit("(?s)."), F.lit(0))

    def pieces(x: Column) -> Column:
        n = F.size(x)
        return F.when(n > 1, F.zip_with(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda p, q: F.concat(p, q))).otherwise(none)

    return F.coalesce(F.array_distinct(F.transform(F.array(letters), pieces)[0]), none)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def shape(c: Column) -> Column:
    """The characters of the normalized request in order of their code, so reordered texts are equal."""
    return F.array_join(F.array_sort(F.split(normalize_request(c), "")), "")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def estimate_tokens(c: Column) -> Column:
    """One per ideograph and one per four other characters, rounded up."""
    cjk = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return cjk + F.floor((F.length(c) - cjk + 3) / 4).cast("int")


def hits_any(c: Column, terms: list[str]) -> Column:
    """Whether a text contains one of a few terms."""
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(c, F.lit(term))
    return out


def space_edges(c: Column) -> Column:
    """A space between an ideograph and a Latin letter or digit."""
    return F.regexp_replace(F.regexp_replace(c, "([一-鿿])([0-9A-Za-z])", "$1 $2"), "([0-9A-Za-z])([一-鿿])", "$1 $2")


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """A template with ``{slot}`` fields filled; spaces are put at the edges of scripts."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, closed, rest = after.partition("}")
        if not closed or name not in slots:
            raise ValueError(f"unknown or unclosed slot in {template!r}")
        parts += [F.lit(before), slots[name].cast("string")]
    return space_edges(F.concat(*parts, F.lit(rest)))


def surface_forms(c: Column, suffixes: list[str]) -> Column:
    """The text, and the text without the first of the suffixes it ends in if two characters or more stay."""
    trimmed = F.lit(None).cast("string")
    for suffix in reversed(suffixes):
        here = F.substr(c, F.lit(1), F.length(c) - len(suffix))
        trimmed = F.when(F.endswith(c, F.lit(suffix)) & (F.length(c) - len(suffix) >= 2), here).otherwise(trimmed)
    return F.array_compact(F.array(c, trimmed))


def ungrounded_clocks(text: Column, source: Column) -> Column:
    """Clock times in a text that its source doesn't contain."""
    dense = strip_space(source)
    return F.filter(F.regexp_extract_all(text, F.lit(r"([0-9]{1,2}:[0-9]{2})"), F.lit(1)), lambda x: ~F.contains(dense, x))


#: Marks of a second task, and the boundary between two tasks.
SECOND_TASK = r"然后|同时|接着|顺便|再帮我|再查|另外还|并且|并帮|并创建|没解决就|修不好就|如果.{1,20}(解决不了|修不好|不行|没有用).{0,10}(找|联系|转|建)"
BOUNDARY = r"\s*[，,；;]\s*(?:再|然后|接着|同时|并且|还要|另外)\s*"


def names_second_task(c: Column) -> Column:
    return c.rlike(SECOND_TASK)


def two_tasks(c: Column) -> Column:
    """The two clauses of a request with exactly one boundary and five characters or more on either side, else null."""
    parts = F.split(F.regexp_replace(F.trim(c), "[。！？!?]+$", ""), BOUNDARY)
    return F.when((F.size(parts) == 2) & F.forall(parts, lambda p: F.length(p) >= 5), parts)


def time_value(c: Column) -> Column:
    """A minute timestamp, or null for anything that isn't one, 30 February and 25 o'clock included."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz"))


#: Full-width letters, digits and signs, and their ordinary forms.
WIDE, NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))


def plain_name(c: Column) -> Column:
    """Ordinary instead of full-width characters, no outer space, lower case, one kind of separator."""
    spaced = F.trim(F.regexp_replace(F.translate(c, WIDE, NARROW), r"(?U)\s+", " "))
    return F.regexp_replace(F.lower(spaced), r"[ _\-\u2010\u2011]+", "_")


def split_name(c: Column) -> Column:
    """train, val, test or unseen_test, however it is written; null for anything else."""
    name = plain_name(c)
    return F.when(name.isin("valid", "validation", "dev"), "val").when(name.isin("train", "val", "test", "unseen_test"), name)


def group_number(c: Column) -> Column:
    """The last number of a template group's id without leading zeros; null if there is none."""
    found = F.regexp_extract(F.translate(c, WIDE, NARROW), "0*([0-9]+)[^0-9]*$", 1)
    return F.when(found != "", found)
