"""The index of rules: a candidate for every match, and few others."""

import re

import pytest
from pyspark.sql import functions as F

from estatelens.functions.rule_index import RuleIndex, is_plain, matches, required_words
from estatelens.operators import classify, findings
from estatelens.plans import rulepacks as packs
from estatelens.sources.estate import table

CASES = [
    (r"\bcustomfield_(\d{4,6})\b", {"customfield"}), (r"(?i)getUser\s*\(", {"getuser"}), (r"new\s+File\s*\(", {"file"}), (r"ab?cde", {"cde"}), (r"(?:static\s+)?foo", {"foo"}), (r"abc|def", {"abc", "def"}),
    (r"[xyz]abc*d", {"ab"}), (r"log\.info\(", {"info"}), (r"a+bc{0,3}", {"a"}), (r"\w+\s*$", set()), (r"(get|put)Thing(?:er)+", {"thing"}), (r"a|\d", set()), (r"(?:one|three)x", {"one", "three"}),
]


@pytest.mark.parametrize("pattern, words", CASES)
def test_required_words(pattern, words):
    assert required_words(pattern) == words


SAMPLES = [
    'def cf = cfm.getCustomFieldObject("customfield_10001")', 'userManager.GETUSERBYNAME("bob")', "groupManager.getGroup('g')", 'isUserInGroup( u , "g")', 'Unirest.post ("https://x.y/z")',
    "new  URL('http://a.b')", 'HttpRequest.newBuilder().uri(URI.create("https://a"))', "/rest/agile/1.0/board/5", "ComponentAccessor.getX", "new File (x)", "Files.write(p)", 'userKey = "k"', "x.setHidden(true)",
    "lfHide(x)", "ldapSearch (q)", "sql (q)", 'require("a.groovy")', 'include "b.sil"', "import static a.b.C ;", "def x = [1]", "[1].each {", "// SIL thing", "return false;", "return true", "@Foo (x)",
    "#set ($x)", "issue was created", "EscalationService", "inline my script", "y.search (jql)", 'runAs("a.b", x)', "publisher.vm'", "public static void main(", "getFieldValue( \"a-b\" )",
]
FOUND = [p for f in packs.FAMILIES.values() for p, _, _ in f]
ALL = FOUND + [rule.pattern for rule in classify.RULES]


def test_every_match_holds_a_required_word():
    met = 0
    for pattern in ALL:
        for s in SAMPLES:
            if re.search(pattern, s):
                met += 1
                runs = re.findall("[a-z]+", s.lower())
                assert not required_words(pattern) or any(w in r for w in required_words(pattern) for r in runs), (pattern, s)
            assert not is_plain(pattern) or (pattern in s) == bool(re.search(pattern, s))
    assert met >= 50  # the samples reach that many rules


def test_candidates_hold_all_matches_and_follow_the_texts(spark, sf):
    lines = findings.explode_lines(table(spark, sf, "scripts"))
    index = RuleIndex(FOUND)
    pairs = index.candidates(lines, "line").select("script_id", "line_no", "rule").distinct()
    rules = [F.struct(F.lit(k).alias("rule"), F.col("line").rlike(p).alias("hit")) for k, p in enumerate(FOUND)]
    plain = lines.select("script_id", "line_no", F.explode(F.array(*rules)).alias("r")).where("r.hit").select("script_id", "line_no", "r.rule")
    assert plain.join(pairs, ["script_id", "line_no", "rule"], "left_anti").isEmpty()
    assert pairs.count() < 3 * plain.count() and pairs.count() < lines.count() * len(FOUND) / 20


def test_counts_fit_their_bits():
    sizes = [sum((r.kind, r.name, r.part) == g for r in classify.RULES) for g in classify.GROUPS]
    assert max(sizes) < 1 << classify.BITS and classify.BITS * classify.EACH < 64


def test_rules_without_words_nulls_and_large_dictionaries(spark, monkeypatch):
    from estatelens.functions import rule_index

    rows = [(1, "one FILE two"), (2, None), (3, ""), (4, "profiles"), (5, "x1")]
    texts = spark.createDataFrame(rows, "id int, text string")
    index = RuleIndex([r"(?i)file", r"\d", "one"])
    want = {(1, 0), (1, 2), (4, 0), (5, 1)}
    for small in (rule_index.SMALL, 0):
        monkeypatch.setattr(rule_index, "SMALL", small)
        may = index.candidates(texts, "text").join(index.rules(texts, "n int", [(0,), (1,), (2,)]), "rule")
        assert {(r.id, r.rule) for r in may.where(matches(F.col("text"))).collect()} == want
    assert RuleIndex([]).candidates(texts, "text").count() == 0
