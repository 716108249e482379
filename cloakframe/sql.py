"""SQL surface: detect_entities(text) as a table function, and validators as functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import checks, fields, values
from .operators.detect import Detection, Scanner


def register(spark: SparkSession, how: Detection | None = None) -> None:
    """After this, `SELECT d.doc_id, e.* FROM documents d, LATERAL detect_entities(d.text) e` works."""
    wanted = how or Detection()

    class DetectEntities:
        def __init__(self):
            self.scanner = Scanner(wanted)

        def eval(self, text: str):
            for s in self.scanner(text)[0] if text else ():
                yield s.type, s.start, s.end, s.confidence, s.source, s.detector, s.rule

    made = F.udtf(DetectEntities, returnType="type string, start int, end int, confidence double, source string, detector string, rule string")
    spark.udtf.register("detect_entities", made)
    # SQL functions of one expression, where there is a native one; else Arrow functions
    arrow = lambda f, kind: F.arrow_udf(lambda v: pa.array([None if x is None else f(x) for x in v.to_pylist()]), kind)
    for name, f, kind in (("is_iban", checks.iban, "boolean"), ("is_aadhaar", checks.aadhaar, "boolean"), ("host_class", checks.host_class, "string"), ("field_type", fields.field_type, "string"), ("is_public_url", checks.public_url, "boolean")):
        spark.udf.register(name, arrow(f, kind))
    digits = "regexp_replace(v, '[^0-9]', '')"
    prefix = checks.CARD_PREFIX.replace("'", "''")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_card(v STRING) RETURNS BOOLEAN RETURN length({digits}) BETWEEN 13 AND 19 AND NOT rlike({digits}, '^([0-9])\\\\1*$') AND rlike({digits}, '{prefix}') AND luhn_check({digits})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_ssn(v STRING) RETURNS BOOLEAN RETURN rlike({digits}, '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$')")
    normal = F.arrow_udf(lambda t, v: pa.array([None if y is None else values.normal(x, y) for x, y in zip(t.to_pylist(), v.to_pylist(), strict=True)], pa.string()), "string")
    spark.udf.register("normal_value", normal)
