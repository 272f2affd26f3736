"""Decimal arithmetic on expression texts, in Arrow batches.

Four operations, brackets, signs and a percent sign after a number or bracket; results are rounded half up to two
places.  Instead of a value a row can have one of four codes: ``expression_unsupported_char``, ``expression_syntax``,
``division_by_zero``, ``value_out_of_range``.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The longest expression, and the largest operand and result.
LONGEST, LARGEST = 80, Decimal("1e12")
LEXEMES = re.compile(r"([0-9]+(?:\.[0-9]+)?)|([-+*/()%.])").findall
ALLOWED = re.compile(r"[0-9+\-*/().%\s]*")
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2}


class _Fault(Exception):
    pass


def _apply(values: list[Decimal], mark: str) -> None:
    if mark == "neg":
        values.append(-values.pop())
        return
    right, left = values.pop(), values.pop()
    if mark == "/":
        if right == 0:
            raise _Fault("division_by_zero")
        values.append(left / right)
    else:
        values.append(left + right if mark == "+" else left - right if mark == "-" else left * right)


def _stopped(values: list[Decimal], marks: list[str]) -> _Fault:
    """What a reader meets first where the syntax breaks after an operand: a division by a zero that it has just read, or the break."""
    while marks and marks[-1] == "neg":
        _apply(values, marks.pop())
    return _Fault("division_by_zero" if marks and marks[-1] == "/" and values and values[-1] == 0 else "expression_syntax")


def calculate(text: str | None) -> tuple[str | None, str | None]:
    """(value, code) of an expression; precedence is kept on two stacks, so depth costs no recursion."""
    if text is None:
        return None, "expression_syntax"
    if len(text) > LONGEST:
        return None, "value_out_of_range"
    if not ALLOWED.fullmatch(text):
        return None, "expression_unsupported_char"
    values: list[Decimal] = []
    marks: list[str] = []
    operand_next = True
    try:
        for number, mark in LEXEMES(text):  # what is between them is white space
            if number:
                if not operand_next:
                    raise _stopped(values, marks)
                value = Decimal(number)
                if value > LARGEST:
                    raise _Fault("value_out_of_range")
                values.append(value)
                operand_next = False
            elif operand_next:
                if mark == "(":
                    marks.append("(")
                elif mark == "-":
                    marks.append("neg")
                elif mark != "+":
                    raise _Fault("expression_syntax")
            elif mark == "%":
                values.append(values.pop() / 100)
            elif mark == ")":
                while marks and marks[-1] != "(":
                    _apply(values, marks.pop())
                if not marks:
                    raise _Fault("expression_syntax")
                marks.pop()
            elif mark in BINDING:
                while marks and marks[-1] != "(" and (marks[-1] == "neg" or BINDING[marks[-1]] >= BINDING[mark]):
                    _apply(values, marks.pop())
                marks.append(mark)
                operand_next = True
            else:
                raise _stopped(values, marks)
        if operand_next:
            raise _Fault("expression_syntax")
        if "(" in marks:
            raise _stopped(values, marks)
        while marks:
            _apply(values, marks.pop())
        if abs(values[0]) > LARGEST:
            raise _Fault("value_out_of_range")
    except _Fault as fault:
        return None, str(fault)
    return str(values[0].quantize(Decimal("0.01"), ROUND_HALF_UP)), None


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("code", StringType())]))
def _calculate(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([calculate(x if isinstance(x, str) else None) for x in texts], columns=["value", "code"])


def evaluated(expression: Column) -> Column:
    """Struct of the value as DECIMAL(20, 2) and the code."""
    made = _calculate(expression)
    return F.struct(made["value"].cast("decimal(20,2)").alias("value"), made["code"].alias("code"))
