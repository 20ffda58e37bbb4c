"""Reading corpora of files: listing, skipping, probing, contents; and snapshots as the sink."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import file_name

MAX_BYTES = 1 << 20
PROBE = 8192
#: Names that are never read (fixed values).
SKIPPED_NAMES = (".env", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Gemfile.lock")


#: Directories that are never entered (fixed values).
SKIPPED_DIRECTORIES = (".git", "node_modules", "target")
LISTING = "path string, length long, mtime long"


def _relative(root: str) -> Column:
    return F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")


def _kept(path: Column, skipped: tuple[str, ...], rules: list[Ignore] | None) -> Column:
    inside = F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, skipped))) if skipped else F.lit(False)
    return ~F.coalesce(inside, F.lit(False)) & (~ignored(path, rules) if rules else F.lit(True))


def discover(spark: SparkSession, root: str, skipped_directories: tuple[str, ...] = SKIPPED_DIRECTORIES, hidden: bool = True, rules: list[Ignore] | None = None) -> DataFrame:
    """``(path, length, mtime)`` of all files below a folder, but in skipped directories; contents are not read.

    Spark's readers leave out names that begin with a dot or an underscore. With ``hidden`` these are listed too, by the file system's own listing on
    the driver, which walks directories and keeps hidden names alone. ``rules`` as ``read_ignore_rules`` gives them leave out what they match.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select(_relative(root).alias("path"), F.col("length").cast("long").alias("length"), F.unix_micros("modificationTime").alias("mtime"))
    if hidden:
        listed = listed.unionByName(spark.createDataFrame(list(_hidden_files(spark, root, skipped_directories)), LISTING))
    return listed.where(_kept(F.col("path"), skipped_directories, rules))


def _hidden_files(spark: SparkSession, root: str, skipped: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
    """Files that Spark's readers pass over: hidden ones, and all below hidden directories."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting = [(top, "", False)]
    while waiting:
        folder, prefix, below_hidden = waiting.pop()
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            unseen = below_hidden or name[:1] in "._"
            if entry.isDirectory():
                if name not in skipped:
                    waiting.append((entry.getPath(), f"{prefix}{name}/", unseen))
            elif unseen:
                yield f"{prefix}{name}", entry.getLen(), entry.getModificationTime() * 1000


class Ignore(NamedTuple):
    """One line of an ignore file: where it holds, what it matches, whether directories only, and whether it takes back."""

    folder: str
    pattern: str
    directories: bool
    negated: bool


def parse_ignore(folder: str, text: str) -> list[Ignore]:
    """The rules of an ignore file in ``folder`` (empty for the root), in order; patterns are regular expressions over paths below it."""
    found = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:].removeprefix("\\")
        directories = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        regex = "" if anchored else "(?:.*/)?"
        body = body.removeprefix("/")
        i = 0
        while i < len(body):
            if body.startswith("**/", i):
                regex, i = regex + "(?:.*/)?", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                regex, i = regex + "/.*", i + 3
            elif body[i] == "*":
                regex, i = regex + "[^/]*", i + 1
            elif body[i] == "?":
                regex, i = regex + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 2 :]:
                end = body.index("]", i + 2)
                inner = body[i + 1 : end].replace("\\", "\\\\")
                regex, i = regex + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif body[i] == "\\" and i + 1 < len(body):
                regex, i = regex + re.escape(body[i + 1]), i + 2
            else:
                regex, i = regex + re.escape(body[i]), i + 1
        found.append(Ignore(folder, regex, directories, negated))
    return found


def ignored(path: Column, rules: list[Ignore]) -> Column:
    """Whether a path, or a directory that it is in, is ignored: of the rules that match one of these the last decides, deeper folders' rules last.

    Below an ignored directory nothing can be taken back. Rules are few and written by people; they become one expression.
    """
    ordered = sorted(rules, key=lambda r: r.folder.count("/") + bool(r.folder))

    def verdict(part: Column, whole: Column) -> Column:
        state = F.lit(False)
        for r in ordered:
            lead = f"{re.escape(r.folder)}/" if r.folder else ""
            fits = part.rlike(f"^{lead}{r.pattern}$")
            state = F.when(fits & whole if r.directories else fits, F.lit(not r.negated)).otherwise(state)
        return state

    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("d")))
    return F.exists(folders, lambda x: verdict(x["p"], x["d"]))


def read_ignore_rules(spark: SparkSession, root: str, name: str = ".gitignore", skipped: tuple[str, ...] = SKIPPED_DIRECTORIES) -> list[Ignore]:
    """The rules of all ignore files below a folder; these are hidden files, so the driver lists and reads them."""
    jvm = spark.sparkContext._jvm
    found = []
    for path, _, _ in sorted(_hidden_files(spark, root, skipped)):
        folder, _, last = path.rpartition("/")
        if last == name:
            place = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
            stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
            try:
                found += parse_ignore(folder, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return found


def skip_reason(path: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not read, null if it is."""
    return F.when(file_name(path).isin(*SKIPPED_NAMES), "name").when(length > max_bytes, "size")


def is_binary(content: Column) -> Column:
    """Whether the first 8,192 bytes hold a NUL or are no UTF-8; a character cut at the end of the probe is fine."""
    head = F.substring(content, 1, PROBE)
    has_nul = F.coalesce(F.position(F.lit(b"\x00"), head) > 0, F.lit(False))
    whole = lambda n: F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - n).cast("string"))
    cut = F.length(content) > PROBE
    return has_nul | ~(whole(0) | (cut & (whole(1) | whole(2) | whole(3))))


def read_corpus(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, skipped_directories: tuple[str, ...] = SKIPPED_DIRECTORIES, rules: list[Ignore] | None = None) -> DataFrame:
    """``(path, text, outcome)``: text of readable files; others keep the outcome that says why they have none.

    Skipped directories and ignored paths are left out, and names and sizes judged, before a content is looked at: names and lengths are columns of the listing.
    Hidden files are listed by ``discover`` only; Spark reads none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_relative(root).alias("path"), "length", "content").where(_kept(F.col("path"), skipped_directories, rules))
    early = skip_reason(F.col("path"), F.col("length"), max_bytes)
    late = F.coalesce(F.when(is_binary(F.col("content")), "binary"), F.when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding"), F.lit("read"))
    judged = rows.withColumn("outcome", F.when(early.isNotNull(), early).otherwise(late))
    return judged.select("path", F.when(F.col("outcome") == "read", F.decode("content", "UTF-8")).alias("text"), "outcome")


class VersionConflict(RuntimeError):
    """Another writer has written since the version that this one is based on."""


def _digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a checksum over them that does not depend on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in df.columns)).cast("decimal(38,0)")).cast("string").alias("s")).first()
    return row["n"], row["s"] or "0"


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version that the pointer names, if there is one."""
    pointer = f"{root.rstrip('/')}/_pointer"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pointer)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(pointer).agg(F.max("version")).first()[0]


def write_snapshot(df: DataFrame, root: str, version: int, expected: int | None = None) -> str:
    """Writes a table as a new version and then its pointer, so a reader sees the old version or the new one, whole.

    With ``expected`` the pointer must still name that version (-1: none), else ``VersionConflict``. A version's folder can be made once, so of two writers of one version
    the later fails before it touches the pointer.
    """
    spark = df.sparkSession
    if expected is not None and (current_version(spark, root) if current_version(spark, root) is not None else -1) != expected:
        raise VersionConflict(f"version {current_version(spark, root)}, expected {expected}")
    path = f"{root.rstrip('/')}/v{version:012d}"
    df.write.mode("errorifexists").parquet(path)
    n, checksum = _digest(spark.read.schema(df.schema).parquet(path))
    spark.createDataFrame([(version, path, n, checksum)], "version long, path string, rows long, checksum string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/_pointer")
    return path


def write_if_changed(df: DataFrame, root: str) -> bool:
    """Writes the next version if the table differs from the last one, by count and checksum; whether it did."""
    spark, now = df.sparkSession, current_version(df.sparkSession, root)
    if now is not None:
        last = spark.read.parquet(f"{root.rstrip('/')}/_pointer").orderBy(F.desc("version")).first()
        if (last["rows"], last["checksum"]) == _digest(df):
            return False
    write_snapshot(df, root, 0 if now is None else now + 1, -1 if now is None else now)
    return True


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer's last row names."""
    last = spark.read.parquet(f"{root.rstrip('/')}/_pointer").orderBy(F.desc("version")).first()
    return spark.read.parquet(last["path"])


def json_envelope(df: DataFrame) -> DataFrame:
    """Each row as one compact JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
