"""Ways to cut texts as table functions of SQL, called for each row by ``LATERAL``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import WAYS, spans_of
from ..operators.scoring import cut_spans


def _constant(argument: AnalyzeArgument | None, kind: type, name: str, default=None):
    """The value of a constant argument; anything else is refused before a row is read."""
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, kind) or isinstance(argument.value, bool) != (kind is bool):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


def _schema(heading: bool, text: bool) -> AnalyzeResult:
    schema = StructType().add("nth", IntegerType()).add("start", IntegerType()).add("end", IntegerType())
    schema = schema.add("heading", StringType()) if heading else schema
    return AnalyzeResult(schema.add("text", StringType()) if text else schema)


class Chunks:
    """``chunks(text, way, with_text => true)``: nth, start, end, heading and, unless refused, text of each span of one of the ``WAYS``, by its name. A null text is an empty one."""

    @staticmethod
    def analyze(text: AnalyzeArgument, way: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text must be a string")
        if _constant(way, str, "way") not in WAYS:
            raise ValueError(f"way must be one of {', '.join(WAYS)}")
        return _schema(True, _constant(with_text, bool, "with_text", True))

    def eval(self, text: str | None, way: str, with_text: bool = True) -> Iterator[tuple]:
        body = text or ""
        for n, (a, b, heading) in enumerate(spans_of(body, *WAYS[way])):
            yield (n, a, b, heading, body[a:b]) if with_text else (n, a, b, heading)


class Windows:
    """``windows(text, budget, with_text => true)``: nth, start, end and, unless refused, text of spans of at most ``budget`` characters. A null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, budget: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text must be a string")
        if _constant(budget, int, "budget") < 3:
            raise ValueError("budget must be 3 or more")
        return _schema(False, _constant(with_text, bool, "with_text", True))

    def eval(self, text: str | None, budget: int, with_text: bool = True) -> Iterator[tuple]:
        for n, (a, b) in enumerate(cut_spans(text, budget) if text else ()):
            yield (n, a, b, text[a:b]) if with_text else (n, a, b)


#: Names in SQL.
FUNCTIONS = {"chunks": Chunks, "windows": Windows}


def register_table_functions(spark: SparkSession) -> None:
    """Make all of ``FUNCTIONS`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
