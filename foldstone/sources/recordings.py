"""Recordings of any length: headers first, then byte ranges, never a file in a row.

A file column of bytes ends at 2 GB and puts a recording of hours into one
task. Here the list of files is a table of paths; tasks read the headers by
seeking, every recording becomes ranges of whole frames, ranges are dealt to
tasks evenly, and each reads only its bytes plus the halo a window needs
beyond its hop. The frames are those of :func:`foldstone.sources.audio.frames_of`.

Files are opened by URI through pyarrow's file systems, on executors only.
"""

from __future__ import annotations

from fnmatch import fnmatchcase
from functools import reduce
from itertools import groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import containers as C

#: Samples of one channel a task holds at a time: about 4 MB decoded.
RANGE_SAMPLES = 1 << 20
#: Rows of frames handed over at once.
BATCH_ROWS = 256
#: Files that are written to a folder, about.
FOLDER_FILES = 1024
#: Paths that are handed over at once, and folders that a task lists at most where there are many.
LISTED_ROWS, LISTED_FOLDERS = 1 << 14, 64

_PLAN = "path string, rate int, channels int, tag int, bits int, offset bigint, frames bigint, load_error string"


def _uri(root: str) -> str:
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def list_files(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """(path) of the matching files below ``root``; no content is read. As by Spark, files of no bytes and hidden ones are left out.

    Folders are listed in tasks, a level of folders at a time, and what they
    hold is stored; the driver learns only how many folders a level has. A
    folder is listed by one task, so many files belong in many folders.
    """

    def run(batches):
        for pdf in batches:
            for uri in pdf["path"]:
                system, base = fs.FileSystem.from_uri(uri)
                found = []
                for info in system.get_file_info(fs.FileSelector(base)):
                    folder = info.type == fs.FileType.Directory
                    if not info.base_name.startswith(("_", ".")) and (folder or info.size and fnmatchcase(info.base_name, glob)):
                        found.append((f"{uri.rstrip('/')}/{info.base_name}", folder))
                for at in range(0, len(found), LISTED_ROWS):
                    yield pd.DataFrame(found[at : at + LISTED_ROWS], columns=["path", "folder"])

    level, files = spark.createDataFrame([(_uri(root),)], "path string"), []
    while n := level.count():
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // LISTED_FOLDERS)))
        seen = materialise(level.repartition(tasks).mapInPandas(run, "path string, folder boolean"), "listed")
        files.append(seen.where("NOT folder").select("path"))
        level = seen.where("folder").select("path")
    return reduce(DataFrame.unionByName, files)


def folder_of(key: Column, n: int) -> Column:
    """A folder for each of ``n`` files, :data:`FOLDER_FILES` of them in each, about."""
    return F.pmod(F.xxhash64(key), F.lit(n // FOLDER_FILES + 1)).cast("string")


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _reader(handle):
    return lambda at, count: handle.read_at(count, at)


def plan(files: DataFrame) -> DataFrame:
    """A row a file: the layout of its samples, or why it has none.

    Reads a few dozen bytes a file, whatever its length.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with _open(path) as handle:
                        of = C.layout(_reader(handle), handle.size())
                    rows.append((path, of.rate, of.channels, of.tag, of.bits, of.offset, of.frames, None))
                except Exception as error:  # a bad file is a finding
                    rows.append((path, *[None] * 6, f"{type(error).__name__}: {error}"))
            names = [c.split()[0] for c in _PLAN.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype(
                {"rate": "Int32", "channels": "Int32", "tag": "Int32", "bits": "Int32", "offset": "Int64", "frames": "Int64"}
            )

    return files.select("path").mapInPandas(run, _PLAN)


def ranges(planned: DataFrame, window: int, hop: int, samples: int = RANGE_SAMPLES) -> DataFrame:
    """(plan columns, first, last): ranges of centred frames, about ``samples`` long each.

    Unreadable and empty recordings have none.
    """
    if window < 1 or hop < 1:
        raise ValueError("window and hop must be positive")
    step = max(1, samples // hop)
    # centred frames start at 0, hop, ... up to the length, as far as the window fits into the padding
    count = F.floor((F.col("frames") + 2 * (window // 2) - window) / hop) + 1
    starts = F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(step).cast("bigint"))
    rows = planned.where(F.col("load_error").isNull() & (F.col("frames") > 0) & (count > 0))
    return rows.select("*", F.explode(starts).alias("first"), count.alias("_count")).select(
        *planned.columns, "first", F.least(F.col("first") + step, F.col("_count")).alias("last")
    )


def range_frames(
    planned: DataFrame, window: int, hop: int, samples: int = RANGE_SAMPLES, partitions: int | None = None
) -> DataFrame:
    """(path, frame_idx, vec): centred frames of the channel mean at the native rate.

    Zeros stand before the first and after the last sample. Ranges, not files,
    are dealt to tasks, so one long recording keeps many of them busy; a lost
    task reads its ranges again.
    """
    pieces = ranges(planned, window, hop, samples)
    keys = ["path", "first"]
    pieces = pieces.repartition(partitions, *keys) if partitions else pieces.repartition(*keys)

    def run(batches):
        held, count = [], 0
        for pdf in batches:
            # ranges of one file that came to one task share its handle
            for path, own in groupby(pdf.sort_values(keys).itertuples(index=False), attrgetter("path")):
                with _open(path) as handle:
                    for row in own:
                        for index, cut in _range_blocks(handle, row, window, hop):
                            held.append((path, index, cut))
                            count += len(cut)
                            if count >= BATCH_ROWS:
                                yield _frame_rows(held)
                                held, count = [], 0
        if held:
            yield _frame_rows(held)

    return pieces.mapInPandas(run, "path string, frame_idx bigint, vec array<float>")


def _range_blocks(handle, row, window: int, hop: int):
    """(frame indexes, frames) of a range, :data:`BATCH_ROWS` at a time."""
    of = C.Layout(row.tag, row.channels, row.rate, row.bits, row.offset, row.frames)
    begin = row.first * hop - window // 2
    end = (row.last - 1) * hop - window // 2 + window
    low, high = max(begin, 0), min(end, of.frames)
    raw = handle.read_at(max(high - low, 0) * of.align, of.offset + low * of.align)
    y = np.zeros(end - begin, "float32")
    part = C.samples(raw, of).mean(1)
    y[low - begin : low - begin + len(part)] = part
    view = np.lib.stride_tricks.sliding_window_view(y, window)[::hop]
    for at in range(0, len(view), BATCH_ROWS):
        cut = view[at : at + BATCH_ROWS]
        yield np.arange(at, at + len(cut)) + row.first, cut


def _frame_rows(held: list) -> pd.DataFrame:
    return pd.DataFrame({
        "path": np.repeat(np.array([path for path, *_ in held], object), [len(cut) for *_, cut in held]),
        "frame_idx": np.concatenate([index for _, index, _ in held]), "vec": [frame for *_, cut in held for frame in cut],
    })


def write_files(rows: DataFrame, root: str, name: Column, content: Column) -> DataFrame:
    """(path, bytes) after writing each row as a file below ``root``.

    Names must be distinct and may begin with folders (see :func:`folder_of`).
    A task that runs again writes the same bytes under the same names, so the
    result does not depend on lost executors.
    """

    def run(batches):
        system, folder = fs.FileSystem.from_uri(_uri(root))
        system.create_dir(folder, recursive=True)
        made = set()
        for pdf in batches:
            sizes = []
            for leaf, blob in zip(pdf["name"], pdf["content"]):
                if (inner := leaf.rpartition("/")[0]) and inner not in made:
                    system.create_dir(f"{folder}/{inner}", recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{folder}/{leaf}") as out:
                    out.write(bytes(blob))
                sizes.append(len(blob))
            yield pd.DataFrame({"path": [f"{root}/{leaf}" for leaf in pdf["name"]], "bytes": sizes})

    return rows.select(name.alias("name"), content.alias("content")).mapInPandas(run, "path string, bytes bigint")
