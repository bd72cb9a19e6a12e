"""Unit vectors of the text rules and properties of the similarities."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import similarity as sim
from quillstone.functions import text


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_names(apply):
    assert apply(text.name_full, "5atguru cu1tural shop15 8ashaw super 50", "a k mehrer", "l l c", "Acme Private Limited", "The Company", "https://www.acme.co.in", "Acme 1234567", None, "Société Générale & Cie") == [
        "satguru cultural shop15 bashaw super 50", "ak mehrer", "llc", "acme pvt ltd", "the co", "acme", "acme", "", "ste generale and co",
    ]
    assert apply(text.name_core, "acme pvt ltd", "the co") == ["acme", "the co"]
    assert apply(text.skeleton, "maarkettinng", "100") == ["mrktng", "10"]


def test_addresses(apply):
    assert apply(text.norm_address, "006751 Main Street, New York", "21st Road", "12 West Virginia Avenue", "0 0005 rue de la Paix, Cedex", None) == ["6751 main st ny", "21 rd", "12 wv ave", "0 5 rue de la paix", ""]
    assert apply(text.postcode, "12 A St 560001", "5 B Rd 10001", "006751 X", None) == ["560001", "10001", "", ""]
    assert apply(text.numbers, "12 rd 9 12") == ["12 9"]
    assert apply(text.city, "1 A St, Pune 411, 10001", "x") == ["pune", ""]


def test_scripts(apply):
    """Compatibility forms, accents, and letters of other scripts by their names, on the path that every name takes."""
    assert apply(text.to_ascii, "Ａｃｍé ﬁrm", "राम", "किताब", "Москва", "Θήρα", "Łódź Øst", None, "ABC", "e\u0301") == ["acme firm", "raama", "kitaaba", "moskva", "thera", "lodz ost", "", "abc", "e"]
    assert apply(text.name_full, "Москва Limited", "राम प्राइवेट")[0] == "moskva ltd"
    assert all(x.isascii() and x for x in apply(text.name_full, "राम प्राइवेट लिमिटेड", "தமிழ் நாடு", "Ελλάδα"))
    assert apply(text.norm_address, "१२ Москва Road")[0] == "12 moskva rd"


def test_dictionary(spark):
    """Indic words by position in true pairs: seen twice or more, and in half of the cases."""
    latin = [("S1-1", "Ram Limited"), ("S1-2", "Ram Traders"), ("S1-3", "Raam Limited"), ("S1-4", "One two three"), ("S1-5", "Sita Limited")]
    indic = [("S2-1", "राम, लिमिटेड"), ("S2-2", "राम Traders"), ("S2-3", "राम लिमिटेड"), ("S2-4", "एक दो"), ("S2-5", "सीता लिमिटेड।"), ("S3-9", "राम"), ("S3-8", "Plain name"), ("S3-7", None)]
    records = lambda rows: spark.createDataFrame([(i, n, "x", "india") for i, n in rows], "entity_id string, business_name string, business_address string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(1, 6)] + [("S1-6", None)], "s1_id string, match_id string")
    found = text.learned_dictionary(records(latin), records(indic), truth)
    assert {tuple(r) for r in found.collect()} == {("राम", "ram"), ("लिमिटेड", "limited")}
    names = {r.entity_id: r.business_name for r in text.with_latin_names(records(indic), found).collect()}
    assert names == {"S2-1": "ram limited", "S2-2": "ram Traders", "S2-3": "ram limited", "S2-4": "एक दो", "S2-5": "सीता limited", "S3-9": "ram", "S3-8": "Plain name", "S3-7": None}
    assert {r.entity_id: r.name_full for r in text.normalised(records(indic), found).collect()}["S2-3"] == "ram ltd"


def test_similarity_values():
    assert [round(sim.ratio(a, b), 3) for a, b in (("kitten", "sitting"), ("medical", "media"), ("8250", "8252"), ("", ""), ("a", ""))] == [61.538, 83.333, 75.0, 100.0, 0.0]
    assert sim.token_set("a b c", "c a") == 100.0 and sim.token_set("", "a") == 0.0 and sim.partial("abc", "xxabcxx") == 100.0


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_similarity_properties(a, b):
    def lcs(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    assert sim.common_length(a, b) == lcs(a, b) == sim.common_length(b, a)
    assert sim.ratio(a, a) == 100.0 and sim.jaro_winkler(a, b) == pytest.approx(sim.jaro_winkler(b, a), abs=0.2)
    assert sim.partial(a, b) >= sim.ratio(a, b) * 0.5 - 1e-9


def test_stream_equals_batch(spark, tmp_path):
    from quillstone.operators.retrieval import candidates
    from quillstone.sources.records import Linkage
    from quillstone.streaming.arrivals import StandingIndex, match_arrivals

    t = Linkage(spark, "/root/testdata/sf0.001")
    pool = text.normalised(t.pool)
    t.s1.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.s1.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    match_arrivals(stream, StandingIndex(pool, str(tmp_path / "index")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    key = ["s1_id", "cand_id", "brank", "bscore"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, candidates(text.normalised(t.s1), pool).select(*key).collect()))
