import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import canon
from quillmere.llm.bytepairs import VOCABULARY, BytePairs, token_counts, token_ids
from quillmere.llm.lookalike import look_alike_groups, look_alike_pairs
from quillmere.llm.residue import ResidueModel, held, often, residue_documents, weights


def test_consistent_form_examples():
    given_, wanted = zip(
        ("ＡＢ１２，", "AB12,"),
        ("é", "é"),
        ("ậ", "ậ"),
        ("ậ", "ậ"),
        ("Сос", "Coc"),
        ("е́", "é"),
        ("a​b­c﻿", "abc"),
        ("a b　 c", "a b  c"),
        ("⼯エ", "工工"),
        ("不不", "不不"),
        ("한", "한"),
        ("a\nb\tc", "a\nb c"),
        ("Aa", "Aa"),
        ("。、", "。、"),
        ("①²½", "①²½"),
        ("", ""),
        (None, None),
        strict=True,
    )
    assert canon.canonical_texts(list(given_)) == list(wanted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeoAEȩ̣́́̈̊ạ가각中", max_size=10), max_size=5))
def test_recomposition_equals_the_standard(texts):
    assert canon.canonical_texts(texts) == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_form_is_stable_and_rows_are_apart(texts):
    once = canon.canonical_texts(texts)
    assert canon.canonical_texts(once) == once
    assert once == [canon.canonical_texts([t])[0] for t in texts]


def test_look_alike_pairs(spark):
    texts = [(0, "ab", 0), (2, "ａｂ", 0), (4, "ab", 0), (6, "ab ", 0), (1, "ａｂ", 1), (8, None, 0), (10, " ", 0), (12, "　", 0), (14, "", 0), (16, "​", 0), (18, "Ab", 0)]
    rows = spark.createDataFrame(texts, "uid long, text string, tbl int").withColumn("h1", F.lit("clash")).withColumn("form", F.lit(1))
    assert sorted(r[:] for r in look_alike_pairs(rows.drop("h1", "form")).collect()) == [(0, 2), (2, 4)]
    assert sorted(r[:] for r in look_alike_pairs(rows).collect()) == [(0, 2), (2, 4)]
    assert look_alike_pairs(rows.where("false")).count() == 0


def test_confusable_letters_of_the_public_table():
    table = canon.confusable_table()
    assert len(table) > 6000 and table[ord("а")] == "a"
    letters = canon.confusable_letters()
    assert all(letters[k] == v for k, v in {"ν": "v", "ι": "i", "ρ": "p", "α": "a", "ѵ": "v", "ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "І": "I", "Ꭺ": "A"}.items())
    assert letters["к"] == letters["κ"] == "ĸ" and len(letters) > 500
    assert not any(c in letters for c in "lI1O0mwèéßよ二")
    # a form is its own form, whatever the letter
    every = [*letters, *canon.LOOK_ALIKES]
    once = canon.canonical_texts(every)
    assert canon.canonical_texts(once) == once
    assert canon.canonical_texts(["раураl", "οrdеr ΑΒ", "pin 1lI0O"]) == ["paypal", "order AB", "pin 1lI0O"]


def test_look_alike_groups(spark):
    texts = ["訂單A1", "訂單Ａ1", "訂單A1", "訂單B2", "訂單B2", "ok", "оk", "  ", None, ""]
    rows = spark.createDataFrame([(2 * i, 0, t) for i, t in enumerate(texts)] + [(1, 1, "ok")], "uid long, tbl int, text string").withColumn("raw", F.lit("clash"))
    got = sorted(r[:] for r in look_alike_groups(rows).collect())
    assert got == [(0, 0, 3, 2), (2, 0, 3, 2), (4, 0, 3, 2), (10, 10, 2, 2), (12, 10, 2, 2)]
    assert look_alike_groups(rows.where("false")).count() == 0


@pytest.fixture(scope="module")
def coder():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    return BytePairs.of(VOCABULARY)


def test_encoder_equals_the_public_one(coder):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    from quillmere.llm.bytepairs import PATTERN

    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "aa", "the", "ing", "  ", "\n\n", "中", "文字", "é", "́", "🎉", "'s", "12", "<|endoftext|>", "　", "\x00", "qz", "—"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "中" * 3000, "ab" * 4000, " " * 1000, "퟿"]
    for t in texts:
        assert np.frombuffer(coder.encode_bytes(t), "<i4").tolist() == public.encode_ordinary(t)


def test_token_ids_of_odd_rows(spark, coder):
    rows = spark.createDataFrame([(1, "hello"), (2, ""), (3, None), (4, "hello"), (5, "长" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in token_ids(rows, "doc_id", "text").collect()}
    assert got[1] == got[4] != [] and got[2] == got[3] == []
    assert len(got[5]) == len(np.frombuffer(coder.encode_bytes("长" * 100_000), "<i4"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(rows, "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert token_ids(rows.where("false"), "doc_id", "text").count() == 0


PROSE = ["合同DD100001的到期提醒提前30天发出，收件人为区域经理。", "夜间任务会在03:00重跑失败的部分，成功的结果不会覆盖。", "权限申请需写明用途、期限和数据范围，缺一项就退回。", "Ticket TS-1 was reopened by the night shift and closed two hours later.", "通知模板里的变量写作 {{customer_name}}，发送前由消息平台替换，编辑时不要改动花括号。", "有用户反映点开办法时浏览器显示“404 页面不存在”，原因是链接少了一段路径，补全后即可打开。", "The auditor asked for the list of groups that changed between May and today."]
RESIDUE = ["尊敬的{{客户名称}}：您于[日期]提交的申请已由##负责人##受理。", "404\n页面不存在\n点击重试", "示例文字示例文字。占位占位占位。示例文字示例文字。", "页面需要 JS 才能显示，请启用 JavaScript 后刷新。", "Reminder: {owner} owes [amount] by ${due_date}.", "503 Service Unavailable - Try again later.", "ueskerpw iqpgujr phhtgjq adyxz yjtawq dprquox"]


def test_residue_documents(spark):
    rng = random.Random(2)
    prose = ["\n".join(rng.choice(PROSE) for _ in range(12)) for _ in range(300)]
    odd = [None, "", " \n", "```\nTODO {{x}} 404\n```\n" + prose[0], prose[0] * 40]
    texts = prose + odd + RESIDUE + [RESIDUE[0] + "\n" + prose[1], prose[2] + "\n系统繁忙，请稍后再试"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("waste_chars", F.lit(1))
    hits = {r["doc_id"] for r in residue_documents(rows, "doc_id", "text").collect()}
    first = len(prose) + len(odd)
    assert hits == set(range(first, first + len(RESIDUE))) | {first + len(RESIDUE)}
    assert residue_documents(rows.where("false"), "doc_id", "text").count() == 0


def test_residue_counts_add_up():
    widths = (1 << 18, 1 << 18)
    both, one, other = (held(x, widths)[0] for x in (["ab", "cdef"], ["ab"], ["cdef"]))
    # but for the n-grams at the very beginning, before which nothing stands
    assert all(0 <= int(x.sum()) + int(y.sum()) - int(b.sum()) <= 6 for b, x, y in zip(both, one, other, strict=True))
    tables, weight = held(PROSE, widths)
    assert weight == int(weights(np.array([len(x) + 7 for x in PROSE])).sum())
    model = ResidueModel(np.stack(tables[:3]), np.stack(tables[3:6]), often(tables[6], 0.0015 * weight), often(tables[6], 65), often(tables[7], 0.003 * weight))
    assert all(len(v) == 0 for v in model.judge([]).values())
    assert model.judge(["", "\n"])["waste"].tolist() == [0, 0]
    # what a text gets doesn't depend on the texts judged with it
    alone = [{k: v.tolist() for k, v in model.judge([x]).items()} for x in (*PROSE, *RESIDUE)]
    together = model.judge([*PROSE, *RESIDUE])
    assert all([int(together[k][i])] == x[k] for i, x in enumerate(alone) for k in x)


def test_unknown_notices_are_found(spark):
    """A page without any prose is found by a line that the corpus doesn't have, though no material shows it."""
    rng = random.Random(4)
    prose = ["会议记录\n" + "\n".join(rng.choice(PROSE) for _ in range(12)) for _ in range(1500)]
    texts = [*prose, "会议记录\n存储卷掉线，节点七无应答", "会议记录\n" + PROSE[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue_documents(rows, "doc_id", "text").collect()} == {1500}


def test_copies_and_length_make_nothing_familiar(spark):
    """A notice that a third of all rows hold, whatever its number, and a filler text longer than all others together are found."""
    rng = random.Random(6)
    prose = ["会议记录\n" + "\n".join(rng.choice(PROSE) for _ in range(12)) for _ in range(1500)]
    notice = ["存储卷掉线，节点七无应答。请联系机房" + f" {i % 5}" for i in range(750)]
    filler = ["示例文字占位文字此处填写内容。" * 60_000, "示例文字占位文字此处填写内容。" * 2]
    rows = spark.createDataFrame(list(enumerate(prose + notice + filler)), "doc_id long, text string")
    assert {r["doc_id"] for r in residue_documents(rows, "doc_id", "text").collect()} == set(range(1500, 2252))
    widths = (1 << 18, 1 << 18)
    both, one = held(["示例文字" * 9, "示例文字"], widths)[0][6], held(["示例文字" * 9], widths)[0][6]
    assert one.max() == 2 and both.max() == 3  # 43 characters weigh 2 of 64 parts, 11 weigh 1
