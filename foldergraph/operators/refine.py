"""Prompts for a model about clusters and folders, its replies, and what follows from them; and the plan of moves."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.text import base_name, normal_path, safe_name, stem
from foldergraph.functions.values import LIST_LIMIT, TOP_PROFILE, TOP_TERMS
from foldergraph.operators.keywords import content_entries
from foldergraph.operators.skew import lookup, rank_in_key, salt
from foldergraph.sources.shared import cut

REPLY = "related boolean, removed array<long>, name string, description string, reason string"


def cluster_prompts(members: DataFrame, files: DataFrame, keywords: DataFrame, n: int = 5, most: int | None = None) -> DataFrame:
    """cluster_id, prompt: the cluster's files, numbered in order of id, with folder and first n keywords.

    A prompt is one text for a model and names all files of a cluster; with `most` (None: all) the first so many, and how many more there
    are. Files of which nothing is known are left out, a null name or folder is written as an empty one. The prompts are written, by
    tasks that get more, not larger, as the keywords do; these are counted first and so best a written table.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_files"))
    first = rank_in_key(members.select("cluster_id", "file_id"), ["cluster_id"], ["file_id"], "i")
    first = first if most is None else first.filter(F.col("i") < most)
    words = keywords.filter(F.col("place") <= n).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("words"))
    rows = first.join(files.select("file_id", "name", "parent_dir"), "file_id").join(words, "file_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat((F.col("i") + 1).cast("string"), F.lit(". "), text("name"), F.lit(" (in "), text("parent_dir"), F.lit("): "), text("words"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")
    more = F.lit("") if most is None else F.when(F.col("n_files") > most, F.concat(F.lit("\nand "), (F.col("n_files") - most).cast("string"), F.lit(" more"))).otherwise("")
    ask = 'Do these files belong together?\nFiles:\n{}\nAnswer with JSON only: {{"related": true, "removed": [], "name": "", "description": ""}}'
    head, tail = ask.format("\0").split("\0")
    prompts = rows.groupBy("cluster_id").agg(lines.alias("lines")).join(sizes, "cluster_id").select("cluster_id", F.concat(F.lit(head), "lines", more, F.lit(tail)).alias("prompt"))
    return cut(prompts, "prompts", rows=keywords.count())


def parsed_reply(raw: Column) -> Column:
    """A struct of REPLY; null if the reply, less white space and the fences around it, isn't exactly one JSON object whose fields have
    their types: related true or false, removed whole numbers, the others strings.

    A field that is null or missing gives null, other fields are let through. Not read either are an object that names a field twice
    and a reply that is null alone.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s*(```(json)?)?\s*", ""), r"\s*(```)?\s*$", "")
    # a parser stops after the first value; what follows it can't pass both as an element and as a member
    listed, held = (F.try_parse_json(F.concat(F.lit(a), bare, F.lit(z))) for a, z in (("[", "]"), ('{"v":', "}")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(held, path, "variant"))
    one = F.schema_of_variant(listed).rlike("^ARRAY<OBJECT<") & F.try_variant_get(listed, "$[1]", "variant").isNull()
    fits = lambda name, *kinds: F.coalesce(kind(f"$.v.{name}").isin("VOID", *kinds), F.lit(True))
    typed = fits("related", "BOOLEAN") & fits("removed", "ARRAY<BIGINT>", "ARRAY<VOID>")
    for name in ("name", "description", "reason"):
        typed &= fits(name, "STRING")
    fields = [part.strip().split(" ") for part in REPLY.split(",")]
    return F.when(one & held.isNotNull() & typed, F.struct(*[F.try_variant_get(held, f"$.v.{name}", kind).alias(name) for name, kind in fields]))


def read_replies(replies: DataFrame) -> DataFrame:
    """suggestion_id, unread, related, removed, name, description of replies(suggestion_id, raw): what a reply says, missing fields as
    false or empty. Of several replies to a suggestion the least text counts; a null reply is unread; a null suggestion_id has no row."""
    one = replies.filter("suggestion_id IS NOT NULL").groupBy("suggestion_id").agg(F.min("raw").alias("raw"))
    told = one.select("suggestion_id", parsed_reply(F.col("raw")).alias("r"))
    none = F.array().cast("array<long>")
    return told.select("suggestion_id", F.col("r").isNull().alias("unread"), F.coalesce("r.related", F.lit(False)).alias("related"), F.array_compact(F.coalesce("r.removed", none)).alias("removed"), F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.description", F.lit("")).alias("description"))


def apply_refinements(suggestions: DataFrame, members: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, members) after replies(suggestion_id, raw): not related, it goes; a new name brings its description; removed numbers
    (from 1, in order of file id; others do nothing) leave. A reply that can't be read changes nothing."""
    told = cut(read_replies(replies).filter("NOT unread").withColumnsRenamed({"name": "new_name", "description": "new_description"}), "replies")
    gone = told.filter("NOT related").select("suggestion_id")
    rows = suggestions.join(gone, "suggestion_id", "left_anti").join(told, "suggestion_id", "left")
    renamed = F.coalesce((F.col("new_name") != "") & (F.col("new_name") != F.col("name")), F.lit(False))
    rows = rows.withColumns({"name": F.when(renamed, F.col("new_name")).otherwise(F.col("name")), "description": F.when(renamed, F.col("new_description")).otherwise(F.col("description"))})
    placed = rank_in_key(members.select("suggestion_id", "file_id"), ["suggestion_id"], ["file_id"], "place").withColumn("_salt", salt(members.sparkSession, "file_id"))
    known = members.select("suggestion_id").distinct().join(told.select("suggestion_id", "related", "removed"), "suggestion_id", "left")
    kept = lookup(placed, known, ["suggestion_id"], "_salt").filter("related IS NULL OR (related AND NOT array_contains(removed, place + 1))")
    return rows.select(*suggestions.columns), kept.select("suggestion_id", "file_id")


def _listed(rows: DataFrame, mark: str, most: int | None) -> DataFrame:
    """path, listed: the first `most` names (None: all) of each path of rows(path, name), by name, joined."""
    first = rank_in_key(rows.filter("path IS NOT NULL AND name IS NOT NULL").select("path", "name"), ["path"], ["name"], "i")
    first = first if most is None else first.filter(F.col("i") < most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
    return first.groupBy("path").agg(F.array_join(names, mark).alias("listed"))


def folder_prompts(folders: DataFrame, tree: DataFrame, files: DataFrame, most: int | None = LIST_LIMIT) -> DataFrame:
    """path, prompt of folders(path, name, parent): what the folder holds, and what is above it.

    tree(path, name, parent) tells the subfolders, files(parent_dir, name) the files; `most` names of either at most (None: all), the
    first by name, since a prompt is one text. The folder above was left open by the walk, or the walk would have ended there.
    """
    asked = cut(folders.select("path", "name", "parent"), "asked")
    own = lambda rows, path: rows.select(normal_path(F.col(path)).alias("path"), "name").join(asked.select("path"), "path", "left_semi")
    subs = _listed(own(tree, "parent"), "; ", most).withColumnRenamed("listed", "subs")
    names = _listed(own(files, "parent_dir"), "\n", most).withColumnRenamed("listed", "names")
    rows = asked.join(subs, "path", "left").join(names, "path", "left")
    above = F.when(F.col("parent").isNotNull(), F.concat(F.lit("The folder above it, "), base_name(F.col("parent")), F.lit(", holds a mixture.\n"))).otherwise("")
    held = F.concat(F.lit("Folders in it: "), F.coalesce("subs", F.lit("none")), F.lit("\nIts files, one a line:\n"), F.coalesce("names", F.lit("none")), F.lit("\n"))
    ask = F.lit('Is what it holds one thing, such as the parts of a program or a project? Answer with JSON only: {"related": true, "reason": ""}')
    return rows.select("path", F.concat(F.lit("There is a folder named "), "name", F.lit(".\n"), above, held, ask).alias("prompt"))


def prompted(tree: DataFrame, files: DataFrame, ask: Callable[[str], str], most: int | None = LIST_LIMIT) -> Callable[[DataFrame], DataFrame]:
    """A classifier of folders for walk_guards(): a prompt for each of the folders given, and what `ask` replies to it."""
    return lambda folders: classify_folders(folder_prompts(folders, tree, files, most), ask)


def classify_folders(prompts: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """path, guarded, reason, failed of prompts(path, prompt): ask gives a model's reply to a prompt; a folder whose reply can't be read,
    or whose call fails, is open, and failed is true."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for prompt in frame["prompt"]:
                try:
                    out.append((ask(prompt), None))
                except Exception as e:  # noqa: BLE001  an injected function may raise anything; the folder stays open and says why
                    out.append((None, str(e)[:500] or type(e).__name__))
            yield frame[["path"]].assign(raw=[x for x, _ in out], failed=[x for _, x in out])

    rows = prompts.select("path", "prompt").mapInPandas(run, "path string, raw string, failed string").withColumn("r", parsed_reply(F.col("raw")))
    unread = F.when(F.col("r").isNull(), F.lit("reply not understood"))
    return rows.select("path", F.coalesce("r.related", F.lit(False)).alias("guarded"), F.coalesce("failed", "r.reason", unread, F.lit("")).alias("reason"), F.col("r").isNull().alias("failed"))


def own_keywords(members: DataFrame, files: DataFrame, n: int = TOP_PROFILE) -> DataFrame:
    """suggestion_id, file_id, term, score, place: TF-IDF of each suggestion's files within the suggestion alone, from their contents.

    Members, entries and result are written; tasks get more, not larger, as the files do.
    """
    members = cut(members.select("suggestion_id", "file_id"), "members")
    n_files = files.count()
    entries = cut(content_entries(files, n_files).join(members, "file_id"), "entries", rows=n_files * TOP_TERMS)
    df = entries.groupBy("suggestion_id", "term").agg(F.sum("dup").alias("df"))
    sizes = members.groupBy("suggestion_id").agg(F.count("*").alias("n_files"))
    rows = entries.join(df, ["suggestion_id", "term"]).join(sizes, "suggestion_id")
    rows = rows.select("suggestion_id", "file_id", "term", (F.col("tf") * F.log(F.col("n_files") / F.col("df"))).alias("score"))
    best = Window.partitionBy("suggestion_id", "file_id").orderBy(F.round("score", 9).desc(), "term")
    return cut(rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n), "keywords", rows=entries.count())


EXTENSION = r"(\.[^./]*)$"
NUMBER = r"_([1-9][0-9]{0,17})$"


def _numbered(names: DataFrame) -> DataFrame:
    """The rows of names(suggestion_id, name) that end in _k before the extension: of, the name without it, and k."""
    own, ext = stem(F.col("name")), F.regexp_extract("name", EXTENSION, 1)
    found = names.withColumns({"of": F.concat(F.regexp_replace(own, NUMBER, ""), ext), "k": F.regexp_extract(own, NUMBER, 1)})
    return found.filter("k <> ''").withColumn("k", F.col("k").cast("long"))


def _less(rows: DataFrame, held: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with how many of held(keys, at) have an `at` below the row's value, by places in the common order: no key's rows meet in a task."""
    both = rows.withColumns({"_v": F.col(value), "_kind": F.lit(0)}).unionByName(held.select(*keys, F.col("at").alias("_v"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    both = rank_in_key(both, keys, ["_v", "_kind"], "_all")
    own = rank_in_key(both.filter("_kind = 0"), keys, ["_all"], "_own")
    return own.withColumn(name, F.col("_all") - F.col("_own")).select(*rows.columns, name)


def _free_names(names: DataFrame, held: DataFrame) -> DataFrame:
    """suggestion_id, name, free: whether the first file of a name keeps it. names(suggestion_id, name, c, there); held(suggestion_id, of, at).

    A name X_k may have been given to a file of the name X, which comes before it in order, and to that of no other name. So names are
    settled from short to long: in each round those whose X was settled in the round before.
    """
    keys = ["suggestion_id", "name"]
    parents = names.select("suggestion_id", F.col("name").alias("of"), F.col("c").alias("c_of"))
    later = cut(_less(_numbered(names).join(parents, ["suggestion_id", "of"]), held, ["suggestion_id", "of"], "k", "below"), "numbered")
    step = cut(names.join(later.select(*keys), keys, "left_anti").select(*keys, (~F.col("there")).alias("free")), "free")
    out = [step]
    while True:
        above = step.select("suggestion_id", F.col("name").alias("of"), F.col("free").alias("free_of"))
        given = F.col("k") - F.col("below") <= F.col("c_of") - F.col("free_of").cast("long")
        step = cut(later.join(above, ["suggestion_id", "of"]).select(*keys, (~F.col("there") & ~given).alias("free")), "free")
        if step.isEmpty():
            return functools.reduce(DataFrame.unionByName, out)
        out.append(step)


def move_plan(members: DataFrame, files: DataFrame, suggestions: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """suggestion_id, file_id, folder, new_name: the first file of a name, in order of (name, file_id), keeps it, later ones get _1, _2, ...
    before the extension, the first number that no name before has. present(folder, name): names that are in a folder already.

    The files of a name take the numbers that the names present leave free, in order: the k-th free number is k and as many more as
    numbers are held below it. Whether the name itself is free is settled by _free_names(). A null name counts as an empty one; a file
    without a row in files, or a suggestion without one in suggestions, has no row. No group is brought together in a task.
    """
    keys, spark = ["suggestion_id", "name"], members.sparkSession
    heads = suggestions.select("suggestion_id", safe_name(F.col("name")).alias("folder"))
    rows = members.select("suggestion_id", "file_id").join(files.select("file_id", F.coalesce("name", F.lit("")).alias("name")), "file_id")
    rows = lookup(rows.withColumn("_salt", salt(spark, "file_id")), heads, ["suggestion_id"], "_salt").drop("_salt")
    rows = rank_in_key(rows, keys, ["file_id"], "i")
    names = rows.groupBy(*keys).agg(F.count("*").alias("c"))
    if present is None:
        names, held = cut(names.withColumn("there", F.lit(False)), "names"), spark.createDataFrame([], "suggestion_id long, of string, at long")
    else:
        there = heads.join(present.select("folder", F.coalesce("name", F.lit("")).alias("name")).distinct(), "folder").select(*keys).distinct()
        there = cut(there, "there")
        names = cut(names.join(there.withColumn("there", F.lit(True)), keys, "left").withColumn("there", F.coalesce("there", F.lit(False))), "names")
        held = _numbered(there).select("suggestion_id", "of", F.col("k").alias("at")).join(names.select("suggestion_id", F.col("name").alias("of")), ["suggestion_id", "of"], "left_semi")
    held = cut(held, "held")
    # a held number lets pass the needs that fewer free numbers than theirs lie below of
    gaps = rank_in_key(held.withColumnRenamed("of", "name"), keys, ["at"], "r").select(*keys, (F.col("at") - F.col("r") - 1).alias("at"))
    told = _free_names(names, held).join(gaps.groupBy(*keys).agg(F.lit(True).alias("some")), keys, "left")
    rows = lookup(rows.withColumn("_salt", salt(spark, "file_id")), told, keys, "_salt").drop("_salt")
    rows = cut(rows.withColumn("need", F.col("i") + 1 - F.col("free").cast("long")).drop("i", "free"), "needs")
    plain = rows.filter("some IS NULL OR need = 0").withColumn("more", F.lit(0).cast("long"))
    passed = _less(rows.filter("some AND need > 0"), gaps, keys, "need", "more")
    number = F.col("need") + F.col("more")
    new = F.when(number == 0, F.col("name")).otherwise(F.concat(stem(F.col("name")), F.lit("_"), number.cast("string"), F.regexp_extract("name", EXTENSION, 1)))
    return plain.unionByName(passed).select("suggestion_id", "file_id", "folder", new.alias("new_name"))
