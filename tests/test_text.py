import math

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.functions.udfs import by_parts, hash_vector, repair, repair_and_unescape, split_at_punctuation, split_points
from docsift.queries import ORACLE_SQL, QUERIES

from .plain import tokens_of


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("GSM-R 专用频率", "gsm-r 专 用 频 率 专用 用频 频率 专用频 用频率".split()), ("echo. BDS-B1.", ["echo.", "bds-b1."]), ("échauvi", ["chauvi"]), ("", []), ("。，", [])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, tx.tokenize) == want == tokens_of(text)


def test_clean_resolves_entities_before_tags(spark):
    assert one(spark, "a&nbsp;b &lt;b&gt;x ![i](p.png)", tx.clean) == "a b x"
    assert one(spark, "　a \n b\t", tx.clean) == "a b"
    assert one(spark, None, tx.clean) is None


def test_html_clean_leaves_entities_without_semicolon(spark, tmp_path):
    html = ["<p>a &amp;&amp; b&amp</p>", "&lt &#39 c&#39;d &copy;", "&amp;amp e & f &quot;g&quot;"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.body for r in QUERIES["html_clean"](spark, str(tmp_path)).collect()}
    assert got == {0: "a && b&amp", 1: "&lt &#39 c'd ©", 2: '&amp e & f "g"'}
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(sql.sql(ORACLE_SQL["html_clean"]).fetchall()) == got


def test_mojibake_rule():
    assert repair("浜у搧鎵嬪唽.pdf") == "浜у搧鎵嬪唽.pdf"
    assert repair("璐ｈ▊") == "责訂"
    assert repair("plain é") == "plain é" and repair("") == ""


def test_known_names(spark):
    assert one(spark, "浜у搧鎵嬪唽.pdf", tx.known_source) == "产品手册.pdf"
    assert one(spark, "other.pdf", tx.known_source) == "other.pdf"


def test_stable_ids(spark):
    assert one(spark, "产品手册.pdf", lambda s: tx.stable_id(F.lit("page"), s, F.lit(3))) == "95b111525710"
    assert one(spark, "产品手册.pdf", lambda s: tx.stable_id(s, F.lit(20), F.lit("欺骗式/压制式干扰检测设备"), F.lit(0), F.lit(0))) == "aac93d0580be"


def test_variants_hints_navigation(spark):
    assert one(spark, "对比A产品功能，并说明告警能力？", tx.query_variants) == ["对比A产品功能，并说明告警能力？", "对比A产品功能", "说明告警能力"]
    assert one(spark, ",".join(f"part{k}" for k in range(20)), tx.query_variants)[1:] == [f"part{k}" for k in range(7)]
    assert one(spark, "杂志和产品手册", tx.source_hints) == ["产品手册.pdf", "杂志.pdf"]
    assert one(spark, "nothing", tx.source_hints) == []
    assert one(spark, "有哪些设备", tx.is_navigation) and not one(spark, "设备参数", tx.is_navigation)
    assert "哪些" not in one(spark, "有哪些GSM-R设备", tx.navigation_terms) and "gsm-r" in one(spark, "有哪些GSM-R设备", tx.navigation_terms)


@pytest.mark.parametrize(("start", "end", "gold", "want"), [(110, 112, "111-112", True), (5, 5, "abc", False), (5, 5, None, False), (5, 5, "", False), (5, 6, "6", True), (5, 6, "7", False), (1, 2, "3-4", False), (1, 9, "4-x", False)])
def test_page_matches(spark, start, end, gold, want):
    assert one(spark, gold, lambda g: tx.page_matches(F.lit(start), F.lit(end), g)) is want


def test_coverage_without_terms(spark):
    none = F.array().cast("array<string>")
    assert one(spark, "x", lambda s: tx.lexical_coverage(none, s)) == 0.0
    assert one(spark, "x", lambda s: tx.evidence_coverage(none, none)[0]) == 1.0


def test_salient_terms(spark):
    assert set(one(spark, "什么设备 gsm-r", tx.salient_terms)) == {"么设", "设备", "什么设", "么设备", "什么设备"} - {"什么设备"}


def test_dot(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0], [])], "a array<double>, b array<double>, c array<double>")
    assert row.select(tx.dot(F.col("a"), F.col("b")), tx.dot(F.col("a"), F.col("c"))).first()[:] == (11.0, 0.0)


def test_hash_vectors():
    v = hash_vector(["gsm-r", "and", "gsm-r"])
    assert v[352] == pytest.approx(0.861037, abs=1e-6) and v[47] == pytest.approx(-0.508542, abs=1e-6)
    assert sum(x != 0 for x in v) == 2 and hash_vector([]) == [0.0] * 384
    assert hash_vector(["频率"])[305] == 1.0 and hash_vector(["the"])[222] == 1.0


@pytest.mark.parametrize(("n", "starts"), [(1400, [0, 620, 1240]), (1320, [0, 620]), (700, [0]), (701, [0, 620])])
def test_splitter_without_punctuation(n, starts):
    text = "".join(chr(97 + k % 26) for k in range(n))
    assert split_points(text) == [text[s : s + 700] for s in starts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。；，", min_size=0, max_size=400), st.integers(10, 60))
def test_splitter_covers_the_text(text, size):
    text = " ".join(text.split())
    parts = split_points(text, size, size // 4)
    at = 0
    for part in parts:
        found = text.find(part, max(0, at - size))
        assert found >= 0 and text[at:found].strip() == "" or found <= at
        at = max(at, found + len(part))
    assert text[at:].strip() == "" and all(len(p) <= size for p in parts)


def test_splitter_ends_after_marks_beyond_half(spark):
    assert split_points("a" * 350 + "；" + "b" * 800)[0] == "a" * 350 + "；" + "b" * 349 and split_points("a" * 351 + "；" + "b" * 800)[0] == "a" * 351 + "；"
    assert [len(p) for p in split_points("词，" * 500)] == [700, 380] and split_points("") == []
    assert one(spark, "词，" * 500, split_at_punctuation) == split_points("词，" * 500) and one(spark, None, split_at_punctuation) is None


def test_cut_at_word(spark):
    assert one(spark, "aaa bbb ccc", lambda s: tx.cut_at_word(s, 9)) == "aaa bbb"
    assert one(spark, "aaabbbccc", lambda s: tx.cut_at_word(s, 4)) == "aaab"
    assert one(spark, "aa", lambda s: tx.cut_at_word(s, 4)) == "aa"


def test_notes(spark):
    note = one(spark, "x", lambda s: tx.insufficiency_note(F.lit(0.2), F.array(*[F.lit(f"词{k}") for k in range(9)])))
    assert "coverage=0.20" in note and "词7" in note and "词8" not in note
    assert one(spark, "x", lambda s: tx.insufficiency_note(F.lit(0.35), F.array(F.lit("a")))) == ""
    assert math.isclose(one(spark, "设备", lambda s: tx.evidence_coverage(F.array(s, F.lit("y")), F.array(s))[0]), 0.5)


def test_few_texts_are_held_in_python_at_a_time(spark):
    texts = pa.array([None, "a。" * 500, "b" * 900, "", "c&amp;é"] * 200)
    held = []

    def work(text):
        held.append(text)
        return split_points(text)

    sizes, got = [], []
    for part in by_parts(iter([texts, texts.slice(0, 0)]), work, pa.list_(pa.string())):
        sizes.append(len(part))
        got += part.to_pylist()
        assert len(held) <= sum(sizes)  # no text is worked on before the last part is given back
    assert max(sizes) <= 128 and got == [None if t is None else split_points(t) for t in texts.to_pylist()]


def test_texts_that_need_no_python_do_not_travel(spark):
    rows = spark.createDataFrame([("plain",), ("a" * 701,), ("&lt;é",), ("",), (None,)], "s string")
    sent = rows.select(split_at_punctuation("s").alias("x"), repair_and_unescape("s").alias("y"))
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN (length(s" in plan and "CASE WHEN RLIKE(s" in plan  # null goes in place of the others
    assert [(r.x, r.y) for r in sent.collect()] == [(["plain"], "plain"), (["a" * 700, "a" * 81], "a" * 701), (["&lt;é"], "<é"), ([], ""), (None, None)]
