"""Steps whose work must grow no faster than their input, and rounding as DuckDB has it."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions.fusion import round_even
from sievelight.operators.inject import insert
from sievelight.operators import fluency, learn, segmented, sentence, similarity
from sievelight.plans.base import TASK_ROWS, table
from sievelight.plans import files
from sievelight.plans.catalog import QUERIES
from sievelight.sources import readers


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(extended=True)
    return out.getvalue().split("== Physical Plan ==")[1]


def test_parts_of_a_text_are_made_once(spark):
    """An expression named in a lambda is made again for every part, which is quadratic in a text's sentences."""
    rows = spark.createDataFrame([(i, " ".join(f"Sentence {k}." for k in range(i))) for i in range(6)], "id long, text string")
    made = rows.select("id", "text", insert(F.col("text"), F.lit("ATTACK"), F.lit("middle"), F.col("id")).alias("t"))
    assert plan_of(made).count("regexp_replace(") == 1
    for r in made.collect():
        parts = r.text.replace(". ", ".\x01 ").split("\x01")
        cut = len(parts) if len(parts) == 1 else r.id % (len(parts) - 1) + 1
        assert r.t == "".join(parts[:cut]) + "\nATTACK\n" + "".join(parts[cut:])


def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file may have more splits than the session has cores, of which one has all rows."""
    n = 2 * TASK_ROWS
    pq.write_table(pa.table({"doc_id": range(n), "text": [f"{i:>400}" for i in range(n)]}), tmp_path / "documents.parquet", row_group_size=n, compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        docs = table(spark, f"file://{tmp_path}", "documents")
        held = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(held) == n and max(held) <= TASK_ROWS


def test_corruption_has_the_letters_of_sql(spark):
    """Sharp s has a capital, letters stand alone, and a text of dropped words alone has no result."""
    rows = spark.createDataFrame([(1, "\xdfber"), (2, "ǆABC"), (3, "ﬁXΣ"), (4, "İTİ"), (5, "the"), (6, "")], "id long, text string")
    duck = duckdb.connect()
    for r in rows.select("id", "text", T.corrupt(F.col("text"), "7", ["the"]).alias("t")).collect():
        head = duck.execute("SELECT upper(?[1]) || lower(?[2:]) || ' .'", [r.text, r.text]).fetchone()[0]
        if r.id == 5:
            dropped = duck.execute("SELECT md5('7|0|the') < '8'").fetchone()[0]
            assert r.t == (None if dropped else "The .")
        else:
            assert r.t == (head if r.text else None)


def test_two_digits_are_those_of_sql(spark):
    shares = [k / 1000 for k in range(100_000)]
    found = spark.createDataFrame([(x,) for x in shares], "x double").select("x", F.format_string("%.2f", round_even(F.col("x"), 2)).alias("two")).collect()
    duck = duckdb.connect()
    wanted = dict(duck.execute("SELECT k / 1000.0::DOUBLE, printf('%.2f', round_even(k / 1000.0::DOUBLE, 2)) FROM range(100000) r(k)").fetchall())
    assert [(r.x, r.two) for r in found if wanted[r.x] != r.two] == []


def test_words_are_counted_where_their_text_is(spark):
    """Only texts and what is left of their words' counts move: no exchange by document and word."""
    rows = spark.createDataFrame([(1, "a bb bb"), (2, "bb cc")], "id long, text string")
    assert plan_of(learn.term_frequencies(rows)).count("Exchange hashpartitioning(id") == 1
    assert "hashpartitioning(id#" in plan_of(learn.term_frequencies(rows)) and ", term#" not in "".join(x for x in plan_of(learn.term_frequencies(rows)).splitlines() if "Exchange" in x)
    assert {(r.id, r.term, r.tf) for r in learn.term_frequencies(rows).collect()} == {(1, "bb", 2), (1, "bb bb", 1), (2, "bb", 1), (2, "cc", 1), (2, "bb cc", 1)}
    exchanges = [x for x in plan_of(QUERIES["ngram_lm_perplexity"](spark, "/root/testdata/sf0.001")).splitlines() if "Exchange hashpartitioning(doc_id" in x]
    assert not any(", w#" in x for x in exchanges)


def test_equal_segments_are_encoded_once(spark):
    seen = []

    def encoder(rows):
        seen.append(rows.count())
        return segmented.hashed_encoder(rows)

    docs = spark.createDataFrame([(i, "One two three. Four five six.") for i in range(5)] + [(9, "One two three. Seven eight nine ten.")], "id long, text string")
    out = {r.id: r for r in segmented.segmented_anomaly(docs, docs.where("id = 0"), encoder).collect()}
    assert seen == [3, 1]
    assert all(r.segments == 2 for r in out.values()) and out[0].max_score == out[4].max_score and out[9].worst == "Seven eight nine ten."


def test_products_are_made_in_pieces_of_one_thread(spark):
    """Numpy gives larger products threads of its own, which wait for each other where every core has a task."""
    rng = np.random.default_rng(1)
    for n, m, dim in ((5, 3, 64), (300, 1500, 64), (70, 65, 3), (10, 10, 2000)):
        x, y = rng.random((n, dim)), rng.random((m, dim))
        one, two = similarity._pieces(x), similarity._pieces(y)
        assert one.shape[1] * two.shape[1] * dim <= similarity.PIECE
        assert np.allclose(similarity._flat(similarity._dots(one, two), np.arange(n), m), x @ y.T, atol=1e-12)
    docs, base = -rng.random((700, 16)), rng.random((1100, 16))
    made = lambda v: spark.createDataFrame([(i, r.tolist(), "") for i, r in enumerate(v)], "id long, embedding array<double>, domain string")
    found = {r.id: r.top for r in similarity.top_similarities(made(docs), made(base), most=700).collect()}
    assert np.allclose([found[i][0] for i in range(700)], (docs @ base.T).max(axis=1), atol=1e-14, rtol=0)


def test_words_are_placed_as_sql_places_them(spark):
    rows = spark.createDataFrame([(1, "Größe x größe — ab_1 ǅx"), (2, ""), (3, None), (4, "a b c")], "id long, text string")
    duck = duckdb.connect()
    for r in segmented.hashed_encoder(rows).collect():
        words = {1: ["größe", "größe", "ab_1", "ǆx"]}.get(r.id, [])
        places = [duck.execute("SELECT ('0x' || substr(md5(?), 1, 7))::BIGINT % 64", [w]).fetchone()[0] for w in words]
        counts = np.bincount(places, minlength=64) if words else np.zeros(64)
        assert r.embedding == (counts / (np.sqrt((counts * counts).sum()) or 1.0)).tolist()


def test_segments_are_cut_once(spark):
    texts = ["One two three. Four five. Six seven eight nine!", "no", "", "  a b c", "x" * 200_000, None, "a b c. d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.segments(F.col("text")).alias("s"))
    assert plan_of(rows).count("split(") == 1
    assert [r.s for r in rows.orderBy("id").collect()] == [["One two three.", "Six seven eight nine!"], ["no"], [""], ["a b c"], ["x" * 200_000], None, ["a b c."]]


def test_equal_units_are_one_row_of_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sentence.sparse, "fit", lambda rows, tol: seen.append({(round(r.label, 9), round(r.weight, 9)) for r in rows.collect()}) or (rows.select("row"), 0.0, 0))
    docs = spark.createDataFrame([(i, "One two three. Four five six.", 0) for i in range(3)] + [(9, "One two three. Seven eight.", 1)], "id long, text string, label int")
    sentence.fit(docs, min_df=1)
    # of 6 clean units each weighs 8 / 12, of 2 poisoned ones 2; three clean ones and a poisoned one are the same
    assert seen == [{(0.5, 4.0), (0.0, 2.0), (1.0, 2.0)}]


def test_tasks_of_a_folder_of_texts_do_not_grow_with_its_files(spark, tmp_path):
    """Files lie in folders that tasks list; files beside them are read as well, hidden ones, empty ones and other folders are not."""
    rows = spark.createDataFrame([(f"corpus_{i} é%20", f"text é {i}\r\n") for i in range(700)] + [("corpus_empty", "")], "name string, text string")
    files.write_text_files(rows, f"file://{tmp_path}/d")
    assert max(len(list(p.iterdir())) for p in (tmp_path / "d").iterdir()) < 20
    (tmp_path / "d/injection_x.txt").write_bytes(b"beside")
    for hidden in ("_no.txt", ".no.txt", "no.md"):
        (tmp_path / "d" / hidden).write_text("no")
    (tmp_path / "d/other").mkdir()
    (tmp_path / "d/other/no.txt").write_text("no")
    for path in (f"file://{tmp_path}/d", f"{tmp_path}/d/"):
        read = readers.read_text_dir(spark, path, 1, "s")
        assert read.rdd.getNumPartitions() == readers.READ_TASKS
        assert {(r.id, r.text, r.attack_type) for r in read.collect()} == {(f"s/corpus_{i} é%20", f"text é {i}\r\n", "corpus") for i in range(700)} | {("s/injection_x", "beside", "injection")}


def test_a_text_is_cut_into_tokens_once(spark):
    """A filter on a text's tokens is moved below the exchange that deals texts out and cuts them there too; so did a second pass for ``truncated``."""
    seen = []

    def model(windows):
        seen.append(windows)
        return windows.select("id", "window", F.array(F.lit(0.0), F.size("tokens").cast("double")).alias("value"))

    sizes = [0, 1, 510, 511, 510 + 7 * 446, 511 + 7 * 446, 9_000]
    rows = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in sizes] + [(-1, None), (-2, " \t")], "id long, text string")
    out = fluency.classify(rows.repartition(3), model, ["safe", "INJECTION"])
    assert plan_of(out).count("regexp_extract_all(") == 1
    assert plan_of(QUERIES["windowed_classifier"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all(") == 2  # documents and twins
    duck = duckdb.connect()
    for r in out.collect():
        want = duck.execute("SELECT least(8, 1 + greatest(0, ceil((n - 510) / 446.0::DOUBLE)))::BIGINT, (n > 510 + 7 * 446)::INT FROM (SELECT ?::BIGINT AS n)", [r.id]).fetchone()
        assert (r.windows, r.truncated, r.margin) == (*want, float(min(r.id, 510)))
    assert sorted(r.id for r in out.collect()) == sizes[1:]
    assert seen[0].columns == ["id", "window", "tokens"]
