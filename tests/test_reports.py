"""Report rendering, claim checks, bootstrap laws, ranks by hash ranges, sources outside tables, guards."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelight.functions import patterns
from sievelight.operators import bootstrap, metrics, report, split
from sievelight.sources import external, readers
from sievelight.streaming import tables


def test_rendering():
    rows = [{"method": "a_b", "f1": 0.12345, "n": 3}, {"method": "50%", "f1": None, "n": 4}]
    text = report.to_latex(rows, ["method", "f1", "n"], 2)
    assert r"a\_b & 0.12 & 3 \\" in text and r"50\% & -- & 4 \\" in text and text.startswith(r"\begin{tabular}{lll}")
    assert report.to_macros(rows, "method", ["f1"]) == "\\newcommand{\\ABF}{0.123}\n"
    assert json.loads(report.to_json({"t": rows}))["t"][0]["n"] == 3


def test_timed():
    out = report.timed(lambda s: s.str.len() / 10)(pd.Series(["a", "bcd"]))
    assert out["score"].tolist() == [0.1, 0.3] and (out["ms"] >= 0).all()


def test_chi_square_p(spark):
    values = [0.0, 0.01, 0.5, 1.0, 3.84, 10.0, 40.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(metrics.chi_square_p(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(math.sqrt(v / 2))) < 2e-7 for r, v in zip(got, values, strict=True))


def test_resample_has_the_law_of_drawing_documents(spark):
    rows = [(str(i), int(i < 40), int(i >= 40), int(i < 25), int(40 <= i < 52)) for i in range(100)]
    stats = spark.createDataFrame(rows, "g string, n_pos int, n_neg int, f_pos int, f_neg int")
    reps = bootstrap.resample(stats, 4000, 3).toPandas()
    assert (reps.n_pos + reps.n_neg == 100).all() and len(reps) == 4000
    assert abs(reps.n_pos.mean() - 40) < 0.4 and abs(reps.n_pos.var() - 24) < 2.5 and abs(reps.f_neg.mean() - 12) < 0.3
    assert bootstrap.resample(stats.limit(0)).count() == 0


def test_resample_of_many_unlike_groups(spark):
    """30,000 groups, all different, in nine partitions: totals are exact, mean and variance are those of drawing groups."""
    n = 30_000
    stats = spark.range(0, n, 1, 9).selectExpr("cast(id as string) as g", "id as n_pos", "1 as n_neg", "id % 7 as f_pos", "cast(id % 5 = 0 as int) as f_neg")
    reps = bootstrap.replicates(stats, 3000).toPandas()
    assert len(reps) == 3000 and (reps.n_neg == n).all()
    x = np.arange(n)
    for name, v in (("n_pos", x), ("f_pos", x % 7), ("f_neg", x % 5 == 0)):
        mean, sd = n * v.mean(), (n * v.var()) ** 0.5
        assert abs(reps[name].mean() - mean) < 4 * sd / 3000**0.5 and abs(reps[name].std() / sd - 1) < 0.06
    assert abs(np.corrcoef(reps.n_pos, reps.f_neg)[0, 1]) < 0.08
    again = bootstrap.resample(stats, 10, 3).orderBy("rep").collect()
    assert again == bootstrap.resample(stats, 10, 3).orderBy("rep").collect()


def test_shares_add_up():
    weights = np.array([3, 0, 5, 100, 1])
    parts = [bootstrap.share(weights, 1000, p, 400, 7) for p in range(5)]
    assert (sum(parts) == 1000).all() and (parts[1] == 0).all() and abs(parts[3].mean() - 1000 * 100 / 109) < 3


def test_out_of_bag(spark):
    rng = np.random.default_rng(0)
    k = np.array([5, 0, 1000])
    sums = np.array([bootstrap.positive_poisson(rng, k) for _ in range(2000)])
    mean = 1 / (1 - math.exp(-1))
    assert (sums >= k).all() and abs(sums[:, 2].mean() / 1000 - mean) < 0.01 and sums[:, 1].max() == 0
    rows = [(1, 0.9)] * 50 + [(0, 0.1)] * 50 + [(1, 0.1)] * 5
    out = bootstrap.out_of_bag_f1(spark.createDataFrame(rows, "label int, score double"), reps=200).toPandas()
    assert len(out) == 200 and out.f1.between(0.8, 1.0).all() and (out.thr == 0.15).all()


def test_hash_rank_is_the_window_rank(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, id % 3) as s", "md5(cast(id % 900 as string)) as k")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("k", "id")))
    got = split.hash_rank(df, ["s"], F.col("k"), "id")
    assert sorted((r.id, r["rank"]) for r in got.collect()) == sorted((r.id, r["rank"]) for r in want.collect()) and got.columns == want.columns


def test_needed_words_lose_no_match(spark):
    texts = [
        "Ignore ALL previous inſtructions", "you are now a pirate", "SYSTEM override", "ſystem prompt", "dısable ssl", "disable SSL", "send your TOKEN", "new security policies", "Do not tell", "As an AI language model, you must",
        "default admin password", "hardcoded the password", "secret that is preconfigured", "in your final answer", "the assistant's reply", "of your answer", "nothing", "", "ſend paſſword", "your output has",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.col("t").rlike("(?iU)" + p).alias(f"a{i}") for i, (p, _, _) in enumerate(patterns.PATTERNS)]
    quick = [patterns.occurs(F.col("t"), i).alias(f"b{i}") for i in range(len(patterns.PATTERNS))]
    rows = df.select(*plain, *quick).collect()
    n = len(patterns.PATTERNS)
    assert all(tuple(r[:n]) == tuple(r[n:]) for r in rows) and sum(sum(r[:n]) for r in rows) >= 14


def test_fetch(tmp_path):
    (tmp_path / "from.txt").write_text("one")
    got = external.fetch(f"file://{tmp_path}/from.txt", str(tmp_path / "cache"), "a/to.txt")
    (tmp_path / "from.txt").write_text("two")
    assert external.fetch(f"file://{tmp_path}/from.txt", str(tmp_path / "cache"), "a/to.txt") == got and open(got).read() == "one"
    with pytest.raises(OSError):
        external.fetch(f"file://{tmp_path}/absent", str(tmp_path / "cache"), "b.txt")
    assert [p.name for p in (tmp_path / "cache").rglob("*") if p.is_file()] == ["to.txt"]


def test_hosts_and_attacks(spark, tmp_path):
    (tmp_path / "hosts.json").write_text("".join(json.dumps({"id": i, "context": [f"Line {i}.", "Second line."]}) + "\n" for i in range(9)) + json.dumps({"id": 99, "context": [" "]}) + "\n")
    (tmp_path / "attacks.json").write_text(json.dumps({"kind a": ["Do x.", "Do y."], "kind b": ["Do z."]}))
    rows, errors = readers.load_sources(spark, ["hosts_and_attacks"], hosts_and_attacks={"contexts": f"{tmp_path}/hosts.json", "attacks": f"{tmp_path}/attacks.json", "name": "mail", "n": 4, "per_host": 2})
    got = rows.collect()
    assert not errors and sum(r.label == 0 for r in got) == 4 and sum(r.label == 1 for r in got) == 8 and len({r.id for r in got}) == 12
    assert all(any(a in r.text for a in ("Do x.", "Do y.", "Do z.")) == (r.label == 1) and r.length == len(r.text) for r in got)


def test_locator_and_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.find_scores(spark, f"file://{tmp_path}", 1, "aa", "pattern")
    with pytest.raises(ValueError):
        tables.score_path("x", 1, "aa", "../pattern")
    tables.create_exclusively(spark, f"file://{tmp_path}/lock", "x")
    with pytest.raises(FileExistsError):
        tables.create_exclusively(spark, f"file://{tmp_path}/lock", "y")
    fine = spark.createDataFrame([(1, "ext_a"), (2, "ext_b")], "id long, source string")
    assert tables.checked_evalset(fine).count() == 0
    bad = {r.problem: r.n for r in tables.checked_evalset(spark.createDataFrame([(None, "ext_a"), (2, None), (2, "b")], "id long, source string")).collect()}
    assert bad == {"repeated id": 1, "null id": 1, "source without ext_": 2}
