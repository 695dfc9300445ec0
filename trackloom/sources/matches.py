"""Data sources for many matches at once: a reader with a partition per file (or several small ones), and a sink that commits as a whole.

register(spark) makes spark.read.format("match_files") and df.write.format("match_results") known. Files are
opened where they are read, through Arrow's file systems: a URI of any store that these know, or a local path.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trackloom.schema import TRACKING
from trackloom.sources.files import FRAME_SECONDS

#: Rows of a batch that a reader hands on.
ROWS = 20_000
# Which files hold a match: wide tables of a side, or lines of frames and the match's description.
NAMES = {"wide": r"(?P<match>[^/]+)/(?P<side>home|away)[^/]*\.csv$", "lines": r"(?P<match>[^/]+)_tracking_extrapolated\.jsonl$", "meta": r"(?P<match>[^/]+)_match\.json$"}
ARROW = pa.schema([("match_id", pa.string()), ("frame", pa.int64()), ("timestamp", pa.float64()), ("player_id", pa.string()), ("team", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("confidence", pa.float64()), ("visible", pa.bool_())])


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and its own path of a URI or a local path."""
    if path.startswith("file:"):
        path = path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), f"/{path}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: Partitions beyond which several files share one, as a task that opens a small file takes longer to start than to read it; bytes of files that share one.
PARTITIONS, SHARED = 512, 32 << 20


@dataclass
class OneFile:
    path: str
    match: str
    side: str | None = None
    meta: str | None = None
    size: int = 0


@dataclass
class Files(InputPartition):
    files: list[OneFile]


def dealt(files: list[OneFile]) -> list[Files]:
    """A partition per file; of more than PARTITIONS files so many in a row share one that no more are left, SHARED bytes at most."""
    most, out, size = -(-len(files) // PARTITIONS), [], 0
    for f in files:
        if not out or len(out[-1].files) == most or size + f.size > SHARED:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


def seconds_of(text: str | None) -> float | None:
    """Seconds of H:M:S, M:S or S; None for anything else."""
    parts = (text or "").strip().split(":")
    if len(parts) > 3 or not all(re.fullmatch(r"\s*\d+(\.\d*)?\s*", p) for p in parts):
        return None
    return sum(float(p) * 60**i for i, p in enumerate(reversed(parts)))


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


class MatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "wide")
        if self.kind not in ("wide", "lines"):
            raise ValueError(f"unknown kind {self.kind}")
        self.folder, self.prefix = options["path"], options.get("prefix", "")
        self.normal = options.get("normalize_coords", "true").lower() == "true"
        self.names = {k: re.compile(options.get(k, v)) for k, v in NAMES.items()}

    def partitions(self) -> list[Files]:
        """The files of matches in order of path, dealt to partitions; only names and sizes are read here."""
        system, at = store(self.folder)
        paths = {f.path: f.size for f in sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path) if f.is_file}
        meta = {m["match"]: p for p in paths if (m := self.names["meta"].search(p))}
        out = []
        for path in paths:
            if m := self.names[self.kind].search(path):
                if self.kind == "lines" and m["match"] not in meta:
                    raise ValueError(f"match {m['match']} has no description")
                out.append(OneFile(path, m["match"], m["side"] if self.kind == "wide" else None, meta.get(m["match"]), paths[path] or 0))
        return dealt(out)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.folder)

        def rows() -> Iterator[tuple]:
            for part in partition.files:
                with io.TextIOWrapper(system.open_input_stream(part.path), "utf-8-sig") as lines:
                    yield from self.wide(part, lines) if self.kind == "wide" else self.frames(part, lines, json.loads(system.open_input_stream(part.meta).read()))

        yield from batches(rows())

    def wide(self, part: OneFile, lines: Iterator[str]) -> Iterator[tuple]:
        """Rows of a CSV with two lines before its header and pairs of X, Y from the fourth column on; the ball is left out."""
        names = [x.strip() for x in [next(lines, ""), next(lines, ""), next(lines, "")][2].split(",")]
        players = [(i, n.removeprefix("Player")) for i, n in enumerate(names) if i >= 3 and n.startswith("Player")]

        def number(cell: str) -> float | None:
            try:
                return v if math.isfinite(v := float(cell)) else None
            except ValueError:
                return None

        for line in lines:
            cells = line.rstrip("\r\n").split(",")
            if len(cells) < 3 or not cells[1].strip().isdigit():
                continue
            frame, time = int(cells[1]), float(cells[2])
            for i, player in players:
                x, y = (number(c) for c in (cells[i : i + 2] + ["", ""])[:2])
                seen = x is not None and y is not None
                yield self.prefix + part.match, frame, time, player, part.side, x if seen else None, y if seen else None, float(seen), seen

    def frames(self, part: OneFile, lines: Iterator[str], match: dict) -> Iterator[tuple]:
        """Rows of JSON lines in metres from the pitch's centre; as they are without normalize_coords."""
        sides = {match["home_team"]["id"]: "home", match["away_team"]["id"]: "away"}
        team = {int(p["id"]): sides.get(p["team_id"], "referee") for p in match["players"]}
        length, width = float(match["pitch_length"]), float(match["pitch_width"])
        place = (lambda v, size: None if v is None else (v + size / 2) / size) if self.normal else (lambda v, size: v)
        for line in lines:
            if not line.strip():
                continue
            row = json.loads(line)
            time = seconds_of(row.get("timestamp"))
            time = row["frame"] * FRAME_SECONDS if time is None else time
            for p in row.get("player_data") or ():
                if p["player_id"] not in team:
                    raise ValueError(f"unknown player {p['player_id']} in {part.path}")
                seen = bool(p.get("is_detected"))
                yield self.prefix + part.match, row["frame"], time, str(p["player_id"]), team[p["player_id"]], place(p.get("x"), length), place(p.get("y"), width), float(seen), seen


class MatchFiles(DataSource):
    """Options: path (a folder); kind wide or lines; normalize_coords; prefix of match ids; wide, lines, meta: patterns of file names with a group match (and side)."""

    @classmethod
    def name(cls) -> str:
        return "match_files"

    def schema(self) -> StructType:
        return TRACKING

    def reader(self, schema: StructType) -> MatchReader:
        return MatchReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class ResultWriter(DataSourceArrowWriter):
    """Tasks write below a folder of their own; the driver moves all to the place at commit, or removes all."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.place, self.overwrite, self.config = options["path"].rstrip("/"), overwrite, options.get("config", "{}")
        self.value = options.get("value", "tas")
        json.loads(self.config)
        if missing := [c for c in ("match_id", "frame", self.value) if c not in columns]:
            raise ValueError(f"results lack {missing}")
        self.pending = f"{self.place}/_pending-{uuid.uuid4().hex}"
        system, at = store(self.pending)
        system.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Per match: a table and a chart of the value by frame. Rows of a match may come in several tasks, each with files of its own.

        A task writes into a folder of its own, which it can't make any more once the write was given up.
        """
        system, at = store(self.pending)
        own, files, n, open_files = uuid.uuid4().hex[:12], [], 0, {}
        at = f"{at}/{own}"
        system.create_dir(at, recursive=False)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = re.sub(r"[^\w.-]", "_", str(row["match_id"]))
                    if name not in open_files:
                        system.create_dir(f"{at}/{name}", recursive=False)
                        table, chart = (io.TextIOWrapper(system.open_output_stream(f"{at}/{name}/part-{own}.{kind}"), "utf-8") for kind in ("csv", "svg"))
                        table.write(",".join(row) + "\n")
                        chart.write('<svg xmlns="http://www.w3.org/2000/svg"><polyline fill="none" stroke="black" points="')
                        open_files[name] = table, chart
                        files += [f"{own}/{name}/part-{own}.csv", f"{own}/{name}/part-{own}.svg"]
                    table, chart = open_files[name]
                    safe = [None if isinstance(v, float) and not math.isfinite(v) else v for v in row.values()]
                    table.write(",".join("" if v is None else json.dumps(v) if isinstance(v, str) else str(v) for v in safe) + "\n")
                    if row[self.value] is not None and math.isfinite(row[self.value]):
                        chart.write(f"{row['frame']},{100 - 100 * row[self.value]:.3f} ")
                    n += 1
            for _, chart in open_files.values():
                chart.write('"/></svg>\n')
        finally:
            for pair in open_files.values():
                for f in pair:
                    f.close()
        return Written(files, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = store(self.pending)
        _, place = store(self.place)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if f.path.rstrip("/") != at.rstrip("/") and "/_pending-" not in f.path:
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        done = [m for m in messages if m]
        for name in (f for m in done for f in m.files):
            final = f"{place}/{name.split('/', 1)[1]}"
            system.create_dir(final.rsplit("/", 1)[0], recursive=True)
            system.move(f"{at}/{name}", final)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/config.json") as out:
            out.write(json.dumps(json.loads(self.config) | {"rows": sum(m.rows for m in done)}, sort_keys=True).encode())
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)

    def abort(self, messages: list[Written | None]) -> None:
        """Called by the driver where a task failed for good; nothing but the pending folder was touched."""
        system, at = store(self.pending)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class MatchResults(DataSource):
    """Options: path; value, the column of the chart (0 to 1); config, a JSON mapping that is kept beside the rows."""

    @classmethod
    def name(cls) -> str:
        return "match_results"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    for source in (MatchFiles, MatchResults):
        spark.dataSource.register(source)
