"""Rules that are asked once of each different line find what they find in whole contents."""

import re

from pyspark.sql import functions as F

from estatelens.functions.rule_index import distinct_lines, is_local, may_cross, needed
from estatelens.operators import classify, findings

CONTENTS = [
    "import\ncom.atlassian.jira\ndef\nx = 1", "  import java.util.List\nprintln ", "println x", "return true;\n", "\n\treturn\n true; ", "def a = [\n1]\n[1, 2\n].each {\n}", "x.search (\n'jql')", "public\nclass A",
    'def cf = "customfield_10001"\ndef cf = "customfield_10001"', "#SIL\n\ngetFieldValue(\"a\")", "", None, "x.vm'\r\ny", "issue.setField(a)", "  // SIL Validator\nreturn false;",
]


def test_hits_equal_those_of_whole_contents(spark):
    df = spark.createDataFrame([(k, "a.txt", c) for k, c in enumerate(CONTENTS)], "script_id long, filename string, content string")
    got = {r["script_id"]: sorted(r["hits"]) for r in classify.hits(df).collect()}
    body = F.btrim("content", F.lit(" \t\n\x0b\f\r"))
    tests = [F.coalesce(F.rlike(body if rule.kind == "language" else F.col("content"), F.lit(rule.pattern)), F.lit(False)) for rule in classify.RULES]
    want = {r["script_id"]: [k for k, hit in enumerate(r["h"]) if hit] for r in df.select("script_id", F.array(*tests).alias("h")).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_each_line_is_looked_at_once(spark):
    df = spark.createDataFrame([(k, "a\nUserManager um\nb") for k in range(50)], "script_id long, content string")
    lines = distinct_lines(df, "content")
    assert lines.count() == 3 and findings.of_lines(lines).count() == 1
    assert findings.scan(df).where("line_no = 2").count() == 50


def test_patterns_that_need_more_than_a_line():
    assert may_cross(r"a\s+b") and may_cross("[^x]y") and may_cross("(?s)a.b") and may_cross("(?m)^a") and not may_cross(r"\ba.b\b")
    assert is_local(r"(?m)^a\b") and not is_local("^a") and not is_local("a(?=b)") and not is_local(r"a\z".replace("z", "Z"))
    assert needed(r"\bdef\s+(\w+)\s*=\s*(?:x|y)z{2}") == ("def", "=", "z") and needed("(?i)abc") == ()
    assert all(w in m.group() for p in (r.pattern for r in classify.RULES) for c in CONTENTS if c for m in re.finditer(p, c) for w in needed(p))
