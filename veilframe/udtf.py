"""Table functions for SQL: ``veil_detect(text)`` over all shapes, ``veil_names(text)`` over person names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions.lexicon import DEFAULT
from .functions.patterns import rule_sql
from .operators.detectors import all_detectors
from .operators.names import find_names


def register(spark: SparkSession, detect: str = "veil_detect", names: str = "veil_names") -> None:
    """``detect`` is a SQL function, so its spans come from the same expression as ``plans.engine.detect``, before overlaps are settled;
    ``names`` is Python, as the order of words decides."""
    rules = [(s, (d.id, d.priority, d.risk, d.type)) for d in all_detectors() for s in d.shapes]
    found = f"transform({rule_sql('body', rules, DEFAULT.stopwords)}, m -> named_struct('a', m.start, 'b', m.end, 'v', m.value, 'c', m.confidence, 'd', m.rule.f0, 't', m.rule.f3))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {detect}(body STRING) RETURNS TABLE "
        f"(start INT, `end` INT, value STRING, confidence DOUBLE, detector STRING, type STRING) RETURN SELECT inline({found})"
    )

    class Names:
        def eval(self, text: str):
            yield from find_names(text, DEFAULT)

    fields = "start int, `end` int, value string, confidence double, entity int, part string"
    spark.udtf.register(names, udtf(Names, returnType=fields))
