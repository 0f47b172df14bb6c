"""Readers and writers of the document formats, and the registry of named sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.operators.inject import insert
from sievelight.schema import ROW, draw, make_rows

#: Category of a development file by its prefix.
PREFIXES = ["injection", "authority", "corpus", "perplexity"]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines by the fixed schema: unknown keys are dropped, blank lines skipped."""
    return spark.read.schema(ROW).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


#: How the folders are named in which a folder of texts may have its files, as those of a partitioned table are. Tasks that read one.
FOLDER, READ_TASKS = "part=", 256
#: Bytes of texts that a task holds, about.
READ_BYTES = 4_000_000


def _entries(folder: str) -> Iterator[fs.FileInfo]:
    """Text files that aren't empty, and folders of them, in order; names that begin with _ or a dot are passed over."""
    filesystem, base = fs.FileSystem.from_uri(folder)
    for f in sorted(filesystem.get_file_info(fs.FileSelector(base)), key=lambda f: f.base_name):
        if f.type == fs.FileType.Directory and f.base_name.startswith(FOLDER) or f.type == fs.FileType.File and f.size and f.base_name.endswith(".txt") and f.base_name[0] not in "_.":
            yield f


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for folder in b.column(0).to_pylist():
            found = [(folder, f.base_name, f.type == fs.FileType.Directory) for f in _entries(folder)]
            for lo in range(0, len(found), 4_096):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found[lo : lo + 4_096], strict=True)], names=["folder", "name", "inner"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, value) of files, and of those in folders."""
    names, values, held = [], [], 0
    for b in batches:
        for r in b.to_pylist():
            at = f"{r['folder'].rstrip('/')}/{r['name']}"
            for folder, name in ((at, f.base_name) for f in _entries(at) if f.type == fs.FileType.File) if r["inner"] else [(r["folder"], r["name"])]:
                filesystem, base = fs.FileSystem.from_uri(folder)
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    value = raw.read()
                names.append(name.removesuffix(".txt"))
                values.append(value)
                held += len(value)
                if held >= READ_BYTES or len(names) == 4_096:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["name", "value"])
                    names, values, held = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["name", "value"])


def read_text_dir(spark: SparkSession, path: str, label: int, source: str) -> DataFrame:
    """One row per .txt file that isn't empty; the attack type is the file name's prefix, ``clean`` for label 0.

    Files may be in the folder or in its folders ``part=...``. Tasks list and read them, so no name reaches the driver and the number of tasks
    doesn't grow with that of files.
    """
    found = spark.createDataFrame([(path,)], "folder string").mapInArrow(_listed, "folder string, name string, inner boolean").repartition(READ_TASKS)
    files = found.mapInArrow(_texts, "name string, value binary").select("name", F.col("value").cast("string").alias("value"))
    kind = F.lit("clean") if label == 0 else F.substring_index("name", "_", 1)
    return make_rows(files.select(F.concat(F.lit(f"{source}/"), "name").alias("id"), F.col("value").alias("text"), F.lit(label).alias("label"), F.lit(source).alias("source"), kind.alias("attack_type"), F.lit("").alias("domain"), F.lit(0).alias("length"), F.lit("").alias("group"), F.lit("").alias("meta")))


def category(name, poisoned):
    out = F.when(~poisoned, "clean")
    for p in PREFIXES:
        out = out.when(name.startswith(p), p)
    return out.otherwise("unknown")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, sep="\t", header=True)


def read_signal_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, score, ms) of an append-only CSV; malformed and half-written rows are dropped."""
    return spark.read.csv(path, header=True, mode="DROPMALFORMED", schema="id string, score double, ms double").where("score is not null")


def explode_attacks(spark: SparkSession, path: str) -> DataFrame:
    """(attack_type, attack) of a JSON object that maps categories to lists of strings."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("attack_type", "list")).select("attack_type", F.explode("list").alias("attack"))


def poisoned_hosts(hosts: DataFrame, attacks: DataFrame, n: int, per_host: int = 2, seed: str = "42") -> DataFrame:
    """``n`` hosts in hash order, each with ``per_host`` attacks at positions that cycle; attacks are numbered in hash order."""
    chosen = hosts.dropDuplicates(["text"]).orderBy(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), "id").limit(n)
    total = attacks.count()
    numbered = attacks.withColumn("k", F.row_number().over(Window.partitionBy().orderBy(F.md5(F.concat(F.lit(seed), "attack")), "attack")) - 1)
    each = chosen.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_host - 1))))
    joined = each.withColumn("k", F.pmod(draw(F.lit(seed), F.col("id").cast("string")) + F.col("j"), F.lit(total))).join(F.broadcast(numbered), "k")
    position = F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (F.pmod(draw(F.col("id").cast("string")) + F.col("j"), F.lit(3)) + 1).cast("int"))
    return joined.withColumn("position", position).withColumn("text", insert(F.col("text"), F.col("attack"), F.col("position"), draw(F.lit(seed), F.col("id").cast("string"), F.col("j").cast("string"))))


def explode_targets(spark: SparkSession, path: str, n: int, seed: str = "42") -> DataFrame:
    """Adversarial texts of ``n`` targets: (target, text, nth); the file maps a target to an object with ``adv_texts``."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json("value", "map<string, struct<question: string, adv_texts: array<string>>>")).alias("target", "v"))
    some = each.orderBy(F.md5(F.concat(F.lit(seed), "target")), "target").limit(n)
    return some.select("target", F.posexplode("v.adv_texts").alias("nth", "text"))


def length_band(corpus: DataFrame, poisoned: DataFrame, margin: int = 60, floor: int = 40) -> DataFrame:
    """Corpus rows whose stripped length is within the band of the poisoned lengths."""
    band = poisoned.agg(F.greatest(F.lit(floor), F.min(F.length("text")) - margin).alias("lo"), (F.max(F.length("text")) + 2 * margin).alias("hi"))
    return corpus.join(F.broadcast(band), F.length(F.trim("text")).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def match_lengths(targets: list[tuple[int, str]], candidates: list[tuple[int, str]]) -> dict[str, str]:
    """Greedy nearest length without replacement, the shorter side on ties; targets in the order given.

    Inherently sequential: it works on (length, key) pairs on the driver, never on texts, for generated evaluation sets only.
    """
    import bisect

    left = sorted(candidates)
    out: dict[str, str] = {}
    for n, key in targets:
        if not left:
            break
        at = bisect.bisect_left(left, (n, ""))
        below, above = at - 1, at
        if below >= 0:
            below = bisect.bisect_left(left, (left[below][0], ""))
        pick = below if below >= 0 and (above >= len(left) or n - left[below][0] <= left[above][0] - n) else above
        out[key] = left.pop(pick)[1]
    return out


SOURCES: dict[str, object] = {}


def source(name: str):
    def add(fn):
        if name in SOURCES:
            raise ValueError(f"{name} is registered already")
        SOURCES[name] = fn
        return fn

    return add


def load_sources(spark: SparkSession, names: list[str], **options) -> tuple[DataFrame, dict[str, str]]:
    """The union of named sources, and the errors of those that could not be read, which are skipped."""
    parts, errors = [], {}
    for name in names:
        try:
            parts.append(SOURCES[name](spark, **options.get(name, {})))
        except Exception as e:  # a missing download skips its source
            errors[name] = str(e).split("\n")[0]
    if not parts:
        raise ValueError(f"no source could be read: {errors}")
    return reduce(lambda a, b: a.unionByName(b), parts), errors


@source("jsonl")
def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    return make_rows(read_jsonl(spark, path))


@source("labelled_parquet")
def _labelled(spark: SparkSession, path: str, name: str, text: str = "text", label: str = "label") -> DataFrame:
    """A table of texts with 0/1 labels, such as a prompt-injection collection: label 1 is prompt_injection."""
    df = spark.read.parquet(path)
    kind = F.when(F.col(label) == 1, "prompt_injection").otherwise("clean")
    key = F.md5(F.col(text))
    return make_rows(df.select(F.concat(F.lit(f"{name}/"), key).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"), F.lit(name).alias("source"), kind.alias("attack_type"), F.lit("").alias("domain"), F.lit(0).alias("length"), F.lit("").alias("group"), F.lit("").alias("meta")))


@source("attempts_parquet")
def _attempts(spark: SparkSession, path: str, name: str, levels: list[int], success_only: bool = False) -> DataFrame:
    """Attack attempts (user_input, level, correct) of the given levels, all poisoned, typed by success."""
    df = spark.read.parquet(path).where(F.col("level").isin(levels) & (F.trim("user_input") != ""))
    if success_only:
        df = df.where("correct")
    kind = F.when(F.col("correct"), "successful_attempt").otherwise("attempt")
    return make_rows(df.select(F.concat(F.lit(f"{name}/"), F.md5("user_input")).alias("id"), F.col("user_input").alias("text"), F.lit(1).alias("label"), F.lit(name).alias("source"), kind.alias("attack_type"), F.col("level").cast("string").alias("domain"), F.lit(0).alias("length"), F.lit("").alias("group"), F.lit("").alias("meta")))
