"""Manuscripts: workspaces with a manifest, plain files and folders, through Spark's readers."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_text, sha256
from folioscope.operators.segment import scenes_table

FILE = "path string, text string"


class SourceError(ValueError):
    """Carries a code: missing-manifest, invalid-manifest, missing-chapter, duplicate-scene-id, path-escape, duplicate-slug."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_manifest(text: str) -> dict:
    """A small reader of the manifest's YAML subset: scalars, and a list of flat mappings; JSON is read as it is."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    items: list[dict] | None = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        dash = re.match(r"^(\s*)-\s+(.*)$", line)
        if dash and items is not None:
            items.append({})
            line = dash[2]
        m = re.match(r"^\s*([A-Za-z_][\w.-]*)\s*:\s*(.*)$", line)
        if not m:
            raise SourceError("invalid-manifest", raw)
        key, value = m[1], m[2].strip().strip("\"'")
        inside = items is not None and (dash or raw.startswith(" ")) and items
        if inside:
            items[-1][key] = value
        elif value == "":
            items = out.setdefault(key, [])
        else:
            items = None
            out[key] = int(value) if value.isdigit() else value
    return out


def read_manuscript(spark: SparkSession, folder: str, book_id: str = "book") -> tuple[DataFrame, DataFrame, list[str]]:
    """(chapters, scenes, warnings) of a folder with manuscript.yaml and chapters/*.md, in the manifest's order."""
    try:
        found = spark.read.text(f"{folder}/manuscript.yaml", wholetext=True).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is None:
        raise SourceError("missing-manifest", folder)
    manifest = parse_manifest(found[0])
    listed = manifest.get("chapters")
    if manifest.get("schema_version") != 1 or not manifest.get("language") or not isinstance(listed, list) or not all(c.get("slug") and c.get("title") for c in listed):
        raise SourceError("invalid-manifest", folder)
    rows = []
    for i, c in enumerate(listed):
        file = c.get("file", f"chapters/{c['slug']}.md")
        if ".." in PurePosixPath(file).parts or PurePosixPath(file).is_absolute():
            raise SourceError("path-escape", file)
        rows.append((book_id, manifest["language"], i, c["slug"], c["title"], file))
    order = spark.createDataFrame(rows, "book_id string, lang string, chapter_ord int, slug string, title string, file string")
    files = read_whole(spark, f"{folder}/chapters/*.md").withColumn("file", F.concat(F.lit("chapters/"), F.element_at(F.split("path", "/"), -1)))
    chapters = order.join(files, "file", "left")
    missing = [r.slug for r in chapters.where("text is null").select("slug").collect()]  # at most the manifest's rows
    if missing:
        raise SourceError("missing-chapter", ", ".join(missing))
    chapters = chapters.withColumn("text", normalize_newlines(F.col("text"))).select("book_id", "lang", "chapter_ord", "slug", "title", "file", "text")
    scenes = scenes_table(chapters, ["book_id", "slug"])
    twice = scenes.groupBy("slug", "scene_id").count().where("count > 1").first()
    if twice:
        raise SourceError("duplicate-scene-id", f"{twice.slug}/{twice.scene_id}")
    extra = files.join(order, "file", "left_anti").select("file").collect()  # a folder's file names
    warnings = [f"not in the manifest: {r.file}" for r in extra]
    loose = scenes.where("scene_id = 's0' and implicit").join(chapters.where(F.contains("text", F.lit("<!-- scene:"))).select("slug"), "slug", "left_semi")
    warnings += [f"text before the first scene marker: {r.slug}" for r in loose.select("slug").collect()]
    return chapters, scenes, warnings


def normalize_newlines(text):
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_standalone(spark: SparkSession, path: str, lang: str = "en", book_id: str = "book") -> DataFrame:
    """Chapters of one .md or .txt file, or of all in a folder, in order of their names; equal names are an error."""
    where = path if re.search(r"\.(md|txt)$", path) else [f"{path}/*.{x}" for x in ("md", "txt")]
    parts = []
    for p in [where] if isinstance(where, str) else where:
        try:
            parts.append(read_whole(spark, p))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not parts:
        raise SourceError("missing-chapter", path)
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(F.lit(book_id).alias("book_id"), F.lit(lang).alias("lang"), F.regexp_replace(name, r"\.(md|txt)$", "").alias("slug"), name.alias("file"), normalize_newlines(F.col("text")).alias("text"))
    twice = out.groupBy("slug").count().where("count > 1").first()
    if twice:
        raise SourceError("duplicate-slug", twice.slug)
    return out.withColumn("title", F.col("slug"))


def workspace_of(spark: SparkSession, target: str) -> str | None:
    """The nearest folder, the target's own first and then its parents, that has a manifest; None if none does.

    Folders are asked of the store that the path names, so it may be any that Spark reads.
    """
    found = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    if re.search(r"\.(md|txt|yaml)$", target):
        found = found.getParent()
    while found is not None:
        for inner in ("", "manuscript/"):
            if store.exists(spark._jvm.org.apache.hadoop.fs.Path(found, inner + "manuscript.yaml")):
                return f"{found.toString()}/{inner}".rstrip("/")
        found = found.getParent()
    return None


def open_source(spark: SparkSession, target: str, lang: str = "en") -> DataFrame:
    """Chapters of a target: a text file by itself, else the nearest workspace's manuscript, else a folder of texts."""
    if not re.search(r"\.(md|txt)$", target):
        folder = workspace_of(spark, target)
        if folder:
            return read_manuscript(spark, folder)[0]
    return read_standalone(spark, target, lang)


def content_hashes(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("content_hash", sha256(normalize_text(F.col("text"))))
