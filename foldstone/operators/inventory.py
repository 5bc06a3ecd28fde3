"""Inventories from file names, and the invariants they must meet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import basename, lookup, parent, stem
from ..session import settle
from .ranking import first_by, vocabulary

# -------------------------------------------------------------------- parsers


def _problem(*tests: tuple[Column, str]) -> Column:
    """The first failing test's message, or null."""
    out = None
    for failed, text in tests:
        out = F.when(failed, text) if out is None else out.when(failed, text)
    return out


def _split_once(files: DataFrame, parts: Column) -> DataFrame:
    """``files`` + ``_parts``. A filter on parsed fields would be pushed below a
    plain projection and repeat the whole parse per field; it stops at a
    generator, so the name is split once."""
    return files.withColumn("_parts", F.explode(F.array(parts)))


def parity_gender(actor: Column) -> Column:
    """Odd numbers male, even ones female."""
    return F.when(actor % 2 == 1, "male").when(actor % 2 == 0, "female")


def parse_base(files: DataFrame, path: str = "path") -> DataFrame:
    """The five-field names of the base corpus; ``problem`` is null on good rows.

    Fields are emotion-intensity-statement-repetition-actor. Where the parent
    directory looks like a person's, it must agree with the actor field.
    """
    p, parts = F.col(path), F.col("_parts")
    files = _split_once(files, F.split(stem(p), "-"))
    fields = {name: F.get(parts, F.lit(i)) for i, name in enumerate(V.INVENTORY_FIELDS)}
    number = F.when(fields["actor_code"].rlike(r"^\d{2}$"), fields["actor_code"].try_cast("int"))
    folder = F.nullif(F.regexp_extract(F.coalesce(parent(p), F.lit("")), V.GROUP_DIR_PATTERN, 1), F.lit(""))
    labels = {
        "emotion_label": lookup(V.EMOTIONS, F.col("emotion")),
        "intensity_label": lookup(V.INTENSITIES, F.col("intensity")),
        "statement_label": lookup(V.STATEMENTS, F.col("statement")),
        "repetition_label": lookup(V.REPETITIONS, F.col("repetition")),
    }
    rows = files.select(
        *[c for c in files.columns if c not in ("filename", "filepath", "_parts")],
        basename(p).alias("filename"),
        p.alias("filepath"),
        F.lit(V.MODALITY).alias("modality"),
        F.lit(V.VOCAL_CHANNEL).alias("vocal_channel"),
        *[fields[n].alias(n) for n in V.INVENTORY_FIELDS[:4]],
        number.alias("actor"),
        F.size(parts).alias("_n"),
        folder.try_cast("int").alias("_folder"),
    ).withColumns(labels)
    problem = _problem(
        (F.col("_n") != 5, "field count"),
        (F.col("emotion_label").isNull(), "unknown emotion"),
        (F.col("intensity_label").isNull(), "unknown intensity"),
        (F.col("statement_label").isNull(), "unknown statement"),
        (F.col("repetition_label").isNull(), "unknown repetition"),
        (F.col("actor").isNull() | ~F.col("actor").between(1, V.EXPECTED_GROUPS), "actor"),
        (F.col("_folder").isNotNull() & (F.col("_folder") != F.col("actor")), "directory"),
    )
    return (
        rows.withColumn("gender", parity_gender(F.col("actor")))
        .withColumn("problem", problem)
        .drop("_n", "_folder")
    )


def strict(parsed: DataFrame) -> DataFrame:
    """Good rows; the first bad one fails the job with its name and reason."""
    text = F.concat(F.col("problem"), F.lit(": "), F.col("filename"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(text)).otherwise(F.col("filename"))
    return parsed.withColumn("filename", checked).drop("problem")


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNotNull()).select("filename", "problem")


def to_canonical(
    df: DataFrame,
    *,
    source: str,
    speaker: Column,
    gender: Column,
    label: Column,
    path: str = "path",
    intensity: Column | None = None,
    intensity_label: Column | None = None,
    statement: Column | None = None,
    repetition: Column | None = None,
    actor: Column | None = None,
    problem: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column set for every source, with the defaults of absent fields."""
    codes = {name: code for code, name in V.EMOTIONS.items()}
    code = lookup(codes, F.col("emotion_label"))
    said = statement if statement is not None else F.lit("NA")
    take = repetition if repetition is not None else F.lit("01")
    out = df.select(
        *keep,
        basename(F.col(path)).alias("filename"),
        F.col(path).alias("filepath"),
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{source}_"), speaker).alias("speaker_id"),
        (actor if actor is not None else F.lit(None)).cast("int").alias("actor"),
        gender.alias("gender"),
        (intensity if intensity is not None else F.lit("NA")).alias("intensity"),
        said.alias("statement"),
        take.alias("repetition"),
        label.alias("emotion_label"),
        (intensity_label if intensity_label is not None else F.lit("unspecified")).alias("intensity_label"),
        said.alias("statement_label"),
        take.alias("repetition_label"),
        (problem if problem is not None else F.lit(None).cast("string")).alias("problem"),
    )
    return out.withColumns(
        {"emotion": code, "label": code.cast("int"), "label_idx": code.cast("int") - 1}
    ).select(*keep, *V.INDEX_COLUMNS, "problem")


def base_index(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Base inventory rows in the shared column set."""
    return parsed.drop("modality", "vocal_channel").withColumns(
        {
            "source": F.lit(V.BASE_SOURCE),
            "speaker_id": F.format_string(f"{V.BASE_SOURCE}_%02d", F.col("actor")),
            "label": F.col("emotion").try_cast("int"),
            "label_idx": F.col("emotion").try_cast("int") - 1,
        }
    ).select(*keep, *V.INDEX_COLUMNS, "problem")


def parse_cremad(files: DataFrame, demographics: DataFrame, path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """``actor_sentence_EMOTION_intensity``; sex from the side table, else unknown."""
    parts = F.col("_parts")
    split = _split_once(files, F.split(stem(F.col(path)), "_"))
    rows = split.withColumns({f"_f{i}": F.get(parts, F.lit(i)) for i in range(4)}).withColumn("_n", F.size(parts))
    sexes = demographics.select(
        F.col("ActorID").cast("string").alias("_f0"),
        F.when(F.col("Sex") == "Male", "male").otherwise("female").alias("_sex"),
    )
    joined = rows.join(sexes, "_f0", "left")
    emotion, level = lookup(V.CREMAD_EMOTION, F.col("_f2")), lookup(V.CREMAD_INTENSITY, F.col("_f3"))
    return to_canonical(
        joined, source="CREMA-D", path=path, keep=keep,
        speaker=F.col("_f0"), gender=F.coalesce("_sex", F.lit("unknown")), label=emotion,
        intensity=F.col("_f3"), intensity_label=level, statement=F.col("_f1"),
        problem=_problem(
            (F.col("_n") != 4, "field count"), (emotion.isNull(), "unknown emotion"), (level.isNull(), "unknown intensity")
        ),
    )


def parse_tess(files: DataFrame, path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """``speaker_word_emotion``; the one name that lacks a letter is repaired."""
    parts = F.col("_parts")
    name = F.upper(F.get(parts, F.lit(0)))
    emotion = lookup(V.TESS_EMOTION, F.lower(F.get(parts, F.lit(2))))
    return to_canonical(
        _split_once(files, F.split(stem(F.col(path)), "_")), source="TESS", path=path, keep=keep,
        speaker=F.when(name == "OA", "OAF").otherwise(name), gender=F.lit("female"), label=emotion,
        statement=F.get(parts, F.lit(1)),
        problem=_problem((F.size(parts) != 3, "field count"), (emotion.isNull(), "unknown emotion")),
    )


def parse_savee(files: DataFrame, path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """``[XX_]code+take``; the speaker is the prefix or the parent directory."""
    pattern = "(?i)" + V.SAVEE_PATTERN
    name = stem(F.col(path))

    def part(i):
        return F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))

    speaker = F.upper(F.coalesce(part(1), parent(F.col(path))))
    emotion = lookup(V.SAVEE_EMOTION, F.lower(part(2)))
    return to_canonical(
        files, source="SAVEE", path=path, keep=keep,
        speaker=speaker, gender=F.lit("male"), label=emotion, statement=part(3),
        problem=_problem(
            (~name.rlike(pattern), "name"),
            (speaker.isNull() | ~speaker.isin(*V.SAVEE_SPEAKERS), "speaker"),
        ),
    )


def empty_index(spark) -> DataFrame:
    """The index of a corpus that is not there."""
    from ..sources.tables import INDEX_SCHEMA

    return spark.createDataFrame([], INDEX_SCHEMA)


def merge_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ordered_index(index: DataFrame, order: Sequence[str] = V.SOURCES) -> DataFrame:
    """Declared source order, then path: a total presentation order."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    return index.orderBy(place, "filepath")


def unknown_values(mapping: Mapping[str, str], canonical: Sequence[str]) -> list[str]:
    """Mapped labels outside the canonical set; must be empty before use."""
    return sorted(set(mapping.values()) - set(canonical))


def stray_labels(df: DataFrame, label: str, canonical: Sequence[str]) -> DataFrame:
    """Labels of a table outside the canonical set, with their row counts."""
    known = df.sparkSession.createDataFrame([(x,) for x in canonical], f"{label} {df.schema[label].dataType.simpleString()}")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(known, label, "left_anti")


# ----------------------------------------------------------------- invariants


def _check(df: DataFrame, name: str, expected: Column, found: Column, failed: Column) -> DataFrame:
    return df.where(failed).select(
        F.lit(name).alias("check"), expected.cast("string").alias("expected"), found.cast("string").alias("found")
    )


def inventory_problems(
    df: DataFrame,
    key: str,
    group: str,
    label: str,
    expected_rows: int,
    expected_groups: int,
    rows_per_group: int,
    rows_per_label: Mapping[str, int],
    forbidden: Column,
    attribute: str,
    groups_per_attribute: Mapping[str, int],
    derived: Column,
) -> DataFrame:
    """(check, expected, found) of every failed invariant, none left out.

    Row-level checks share one aggregate pass; the per-group and per-label
    checks read counts grouped once each.
    """
    n = F.count(F.lit(1))
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns])
    head = df.agg(
        n.alias("rows"),
        F.count_if(forbidden).alias("forbidden"),
        F.count_if(~F.col(attribute).eqNullSafe(derived)).alias("derived"),
        F.count_if(nulls).alias("nulls"),
    )
    groups = df.groupBy(group, attribute).agg(n.alias("n"))
    per_group = groups.groupBy(group).agg(F.sum("n").alias("n"))
    group_head = per_group.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") != rows_per_group).alias("off")
    )
    kind = df.schema[label].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame(list(rows_per_label.items()), f"{label} {kind}, want bigint")
    per_label = wanted.join(df.groupBy(label).agg(n.alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    akind = df.schema[attribute].dataType.simpleString()
    shares = df.sparkSession.createDataFrame(list(groups_per_attribute.items()), f"{attribute} {akind}, want bigint")
    per_attribute = shares.join(
        groups.groupBy(attribute).agg(F.count(F.lit(1)).alias("n")), attribute, "full"
    ).withColumns({"n": F.coalesce("n", F.lit(0)), "want": F.coalesce("want", F.lit(0))})
    dupes = df.groupBy(key).agg(n.alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n"))

    def text(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit("="), F.col("n").cast("string"))

    parts = [
        _check(head, "row count", F.lit(expected_rows), F.col("rows"), F.col("rows") != expected_rows),
        _check(dupes, "duplicate keys", F.lit(0), F.col("n"), F.col("n") > 0),
        _check(group_head, "group count", F.lit(expected_groups), F.col("groups"), F.col("groups") != expected_groups),
        _check(group_head, "rows per group", F.lit(rows_per_group), F.col("off"), F.col("off") > 0),
        _check(per_label, "rows per label", F.col("want"), text("", label), F.col("n") != F.col("want")),
        _check(head, "forbidden combination", F.lit(0), F.col("forbidden"), F.col("forbidden") > 0),
        _check(per_attribute, "groups per attribute", F.col("want"), text("", attribute), F.col("n") != F.col("want")),
        _check(head, "derived attribute", F.lit(0), F.col("derived"), F.col("derived") > 0),
        _check(head, "nulls", F.lit(0), F.col("nulls"), F.col("nulls") > 0),
    ]
    return merge_sources(parts)


def base_problems(df: DataFrame) -> DataFrame:
    """:func:`inventory_problems` with the base corpus's constants."""
    per_label = {x: V.NEUTRAL_ROWS if x == "neutral" else V.OTHER_LABEL_ROWS for x in V.LABELS}
    strong_neutral = (F.col("emotion") == "01") & (F.col("intensity") == "02")
    return inventory_problems(
        df, "filename", "actor", "emotion_label", V.EXPECTED_ROWS, V.EXPECTED_GROUPS, V.ROWS_PER_GROUP,
        per_label, strong_neutral, "gender",
        {"female": V.GROUPS_PER_GENDER, "male": V.GROUPS_PER_GENDER}, parity_gender(F.col("actor")),
    )


def index_problems(
    df: DataFrame,
    files: DataFrame | None = None,
    labels: Sequence[str] = V.LABELS,
    published: Mapping[str, int] = V.PUBLISHED_COUNTS,
    columns: Sequence[str] = V.INDEX_COLUMNS,
    key: str = "filename",
    path: str = "filepath",
    source: str = "source",
    group: str = "speaker_id",
    label: str = "emotion_label",
    number: str = "label",
    index: str = "label_idx",
    required: Sequence[str] = ("emotion_label", "speaker_id", "source", "gender"),
) -> DataFrame:
    """(check, expected, found) of every failed invariant of a merged index.

    ``files`` is a listing with ``path``; without it the file check is skipped.
    """
    n = F.count(F.lit(1))
    one = F.count(F.lit(1)).alias("n")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    head = df.agg(
        F.count_if(~F.col(number).between(1, len(labels))).alias("range"),
        F.count_if((place > 0) & ~F.col(index).eqNullSafe((place - 1).cast("int"))).alias("drift"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required if c in df.columns],
    )

    def over_one(column, distinct=None):
        measure = F.count_distinct(distinct) if distinct else n
        return df.groupBy(column).agg(measure.alias("n")).where("n > 1").agg(one)

    sizes = df.groupBy(source).agg(n.alias("n"))
    want = df.sparkSession.createDataFrame(list(published.items()), f"{source} string, want bigint")
    zero = F.lit(0)
    found = F.col("n")
    stray = stray_labels(df, label, labels).select(F.col(label).alias("stray"), F.col("n"))
    parts = [
        _check(stray, "stray label", zero, F.concat_ws("=", "stray", F.col("n").cast("string")), F.lit(True)),
        _check(head, "label range", zero, F.col("range"), F.col("range") > 0),
        _check(head, "label index drift", zero, F.col("drift"), F.col("drift") > 0),
        _check(over_one(path), "duplicate paths", zero, found, found > 0),
        _check(over_one(key), "shared keys", zero, found, found > 0),
        _check(over_one(group, source), "group spans sources", zero, found, found > 0),
        _check(
            sizes.join(want, source), "published count", F.col("want"),
            F.concat_ws("=", source, found.cast("string")), found != F.col("want"),
        ),
    ]
    for c in required:
        if c in df.columns:
            parts.append(_check(head, f"nulls in {c}", zero, F.col(f"null_{c}"), F.col(f"null_{c}") > 0))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        absent = df.sparkSession.createDataFrame([(",".join(missing),)], "n string")
        parts.append(_check(absent, "missing columns", F.lit("none"), F.col("n"), F.lit(True)))
    if files is not None:
        gone = df.select(F.col(path).alias("path")).join(files.select("path"), "path", "left_anti").agg(one)
        parts.append(_check(gone, "missing files", zero, found, found > 0))
    return merge_sources(parts)


def require_valid(found: DataFrame) -> None:
    """Raise once, naming every failed check. Checks are few."""
    lines = [f"{r['check']}: expected {r['expected']}, found {r['found']}" for r in found.collect()]
    if lines:
        raise ValueError("invariants failed:\n  - " + "\n  - ".join(sorted(lines)))


def summarise_sources(
    df: DataFrame, source: str, group: str, label: str, attribute: str, levels: Sequence[str]
) -> DataFrame:
    """Rows, distinct groups and labels, level counts per source plus TOTAL.

    Rows shrink to distinct (source, group, label, level) first; the total is
    recomputed from those, not summed.
    """
    cells = df.groupBy(source, group, label, attribute).agg(F.count(F.lit(1)).alias("_n"))
    out = cells.rollup(source).agg(
        F.grouping(source).alias("_g"),
        F.sum("_n").alias("rows"),
        F.count_distinct(group).alias("groups"),
        F.count_distinct(label).alias("labels"),
        *[F.coalesce(F.sum(F.when(F.col(attribute) == v, F.col("_n"))), F.lit(0)).cast("bigint").alias(str(v)) for v in levels],
    )
    name = F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(source))
    return out.withColumn(source, name).drop("_g")


def label_coverage(df: DataFrame, label: str, source: str, labels: Sequence, sources: Sequence[str]) -> DataFrame:
    """Label x source counts in declared order, TOTAL, share text, source list."""
    kind = df.schema[label].dataType.simpleString()
    frame = df.sparkSession.createDataFrame(list(enumerate(labels)), f"_o int, {label} {kind}")
    wide = df.groupBy(label).pivot(source, list(sources)).count()
    table = frame.join(wide, label, "left").fillna(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in sources])
    from pyspark.sql.window import Window

    # as many rows as there are labels
    whole = F.sum("TOTAL").over(Window.partitionBy(F.lit(0)))
    named = F.array(*[F.when(F.col(f"`{s}`") > 0, F.lit(s)) for s in sources])
    return (
        table.withColumn("TOTAL", total)
        .withColumn("share", F.format_string("%.1f%%", 100.0 * F.col("TOTAL") / whole))
        .withColumn("sources", F.array_join(F.array_compact(named), ", "))
        .drop("_o")
    )


def content_duplicates(df: DataFrame, content: str, source: str, name: str, sample: int = 4) -> DataFrame:
    """(md5, n, sources, cross_source, files) of content found more than once.

    Counts per (digest, source) first; only ``sample`` names per digest are
    kept, cut on the map side, so a third of all rows being one copy is fine.
    """
    hashed = df.select(F.md5(content).alias("_d"), F.col(source).alias("_s"), F.col(name).alias("_k"))
    per_source = hashed.groupBy("_d", "_s").agg(F.count(F.lit(1)).alias("_n"))
    groups = per_source.groupBy("_d").agg(
        F.sum("_n").alias("n"),
        F.array_sort(F.collect_set("_s")).alias("_sources"),  # sources are a closed vocabulary
    ).where("n > 1")
    groups = settle(groups)
    names = (
        first_by(hashed.join(groups.select("_d"), "_d", "left_semi"), "_d", [F.col("_k")], sample)
        .groupBy("_d")
        .agg(F.array_join(F.array_sort(F.collect_list("_k")), ", ").alias("files"))
    )
    return groups.join(names, "_d").select(
        F.left("_d", F.lit(12)).alias("md5"),
        "n",
        F.array_join("_sources", ", ").alias("sources"),
        (F.size("_sources") > 1).alias("cross_source"),
        "files",
    )


def present_sources(index: DataFrame) -> list[str]:
    """Sources with rows, in declared order."""
    found = set(vocabulary(index, "source"))
    return [s for s in V.SOURCES if s in found]
