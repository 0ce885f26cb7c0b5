"""From catalogue entries to artifacts: frames, manifests, media, digests.

Entries are rows of (ord, name).  Frames are an explode over frame ranges, so a clip of 20 000
frames is many rows of work rather than one; encoded frames are brought together per entry in
ranges, and only names, digests and lengths leave the tasks unless bytes are asked for.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from fractions import Fraction as F

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from framewright.functions import containers, jpeg
from framewright.functions import scene as sc
from framewright.operators.validate import check_entry
from framewright.plans import catalogue as ct

RANGE = 500  # frames in a row of work


def parse_name(name: str) -> dict:
    """The entry that a name describes; ValueError for a name that no entry has."""
    parts = name.split("-")
    try:
        w, h = (int(x) for x in parts[0].split("x"))
        fields = dict(zip(("rate", "background", "shape", "motion", "coding", "container", "track_matrix", "scale"), parts[2:10], strict=True))
        e = {"dimensions": (w, h), "frame_count": int(parts[1]), **fields, "capture": None}
        rest = parts[10:]
        if "cap" in rest[0][:5] and rest[0].replace("qt", "", 1).startswith("cap"):
            carrier = "meta" if rest[0].startswith("qt") else "cfps"
            num, _, den = rest[0].removeprefix("qt").removeprefix("cap").partition("x")
            e["capture"] = (F(int(num), int(den or 1)), carrier)
            rest = rest[1:]
        e["defect"] = "-".join(rest)
    except (ValueError, IndexError) as err:
        raise ValueError(f"no entry is called {name}") from err
    if ct.entry_name(e) != name or e["defect"] not in (*ct.AXES["defect"], "no-dim") or any(e[k] not in ct.AXES[k] for k in fields):
        raise ValueError(f"no entry is called {name}")
    check_entry(e, ct.RATES[e["rate"]])
    return e


def _ratio(x: F) -> dict:
    return {"den": x.denominator, "num": x.numerator}


def _point(p) -> dict:
    return {"x": _ratio(p[0]), "y": _ratio(p[1])}


def canonical_object(pairs: list[tuple[str, object]]) -> str:
    """An object of keys in the order written: of one key that stands twice the last value counts."""
    for key, _ in pairs:
        if not re.fullmatch(r"[a-z_]+", key):
            raise ValueError(f"{key!r} is no key")
    return canonical(dict(pairs))


def canonical(value) -> str:
    """JSON without white space, keys sorted by bytes; numbers are integers or pairs of them."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def frame_json(scene: dict, frame: int, walks: sc.Walks) -> dict:
    m = sc.camera_at(scene["camera"], frame, walks)[0].to_affine()
    states = []
    for s in sc.object_states(scene, frame, walks):
        box = s["extent"]
        if box is None:
            continue
        state = {
            "bbox": {k: _ratio(getattr(box, k)) for k in ("max_x", "max_y", "min_x", "min_y")}, "centre_screen": _point(s["centre_screen"]),
            "index": s["index"], "on_screen": _ratio(sc.visible_fraction(box, scene["width"], scene["height"])),
        }
        if scene["scale"] is not None:
            state["centre_world"] = _point([c / scene["scale"] for c in s["centre_scene"]])
        states.append(state)
    return {"camera": {k: _ratio(getattr(m, k)) for k in ("a", "b", "c", "d", "tx", "ty")}, "index": frame, "objects": states}


def head_json(name: str, e: dict, scene: dict) -> dict:
    """The manifest but for its frames."""
    out = {
        "background": e["background"], "dimensions": {"height": scene["height"], "width": scene["width"]}, "frame_count": scene["frame_count"], "frame_rate": _ratio(scene["rate"]), "name": name,
        "objects": [{"index": i, "shape": o["shape"]["kind"], "visible": {"end": o["end"], "start": o["start"]}} for i, o in enumerate(scene["objects"])], "schema_version": 1,
    }
    if scene["scale"] is not None:
        out["scale"] = _ratio(scene["scale"])
    if e["capture"]:
        out |= {"capture_rate": _ratio(e["capture"][0]), "capture_carrier": e["capture"][1]}
    return out


def manifest_json(e: dict) -> str:
    scene, walks = ct.scene_of(e), sc.Walks()
    return canonical(head_json(ct.entry_name(e), e, scene) | {"frames": [frame_json(scene, n, walks) for n in range(scene["frame_count"])]})


class FrameCoder:
    """Encoded frames of one entry; equal object states give equal pixels, which are coded once."""

    def __init__(self, e: dict) -> None:
        self.entry, self.scene, self.walks = e, ct.scene_of(e), sc.Walks()
        self.back = sc.backdrop(self.scene["background"], self.scene["width"], self.scene["height"])
        self.known: dict = {}

    def frame(self, n: int) -> bytes:
        # the camera turns and zooms shapes about centres that may stay where they are
        m, z = sc.camera_at(self.scene["camera"], n, self.walks)
        key = (m.xx, m.xy, z, *((s["index"], s["centre_screen"]) for s in sc.object_states(self.scene, n, self.walks)))
        got = self.known.get(key)
        if got is None:
            px = sc.paint(self.back.copy(), self.scene, n, self.walks)
            got = jpeg.encode(px) if self.entry["coding"] == "mjpeg" else px.tobytes()
            if len(self.known) > 256:
                self.known.clear()
            self.known[key] = got
        return got


def mux(e: dict, frames: list[bytes]) -> bytes:
    """The container of all frames, with the entry's fault in it."""
    w, h = e["dimensions"]
    rate, is_jpeg = ct.RATES[e["rate"]], e["coding"] == "mjpeg"
    if e["container"] == "iso":
        data = containers.iso_file(frames, width=w, height=h, jpeg=is_jpeg, rate=rate, turn=e["track_matrix"], capture=e["capture"])
    else:
        data = containers.avi_file(frames, w, h, is_jpeg, rate)
    return data if e["defect"] == "nodef" else containers.inject(data, e["defect"])


def media(e: dict) -> bytes:
    coder = FrameCoder(e)
    return mux(e, [coder.frame(n) for n in range(e["frame_count"])])


# ---------------------------------------------------------------- DataFrames


def catalogue(spark: SparkSession) -> DataFrame:
    """(ord, name, frame_count, pixels) of all entries.  The greedy cover is sequential and small (1419 pairs): it runs on the driver."""
    rows = ct.entries([tuple(r) for r in ct.pair_obligations(spark).collect()])
    data = [(i, ct.entry_name(e), e["frame_count"], e["dimensions"][0] * e["dimensions"][1]) for i, e in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, name string, frame_count long, pixels long")


def frame_ranges(entries: DataFrame, width: int = RANGE) -> DataFrame:
    """(name, first, last) in pieces of at most ``width`` frames, so that long clips are many tasks' work."""
    e = entries.where("name is not null").select("name", "frame_count")
    start = SF.explode(SF.sequence(SF.lit(0).cast("long"), SF.col("frame_count") - 1, SF.lit(width).cast("long")))
    return e.select("name", "frame_count", start.alias("first")).select("name", "first", SF.least(SF.col("first") + width, "frame_count").alias("last"))


def encoded_ranges(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(name, first, media, manifest): encoded frames of each range, and their part of the manifest.

    ``media`` holds the frames' bytes one after another with their sizes in ``sizes``.
    """
    ranges = frame_ranges(entries)
    n = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: FrameCoder | None = None
        for b in batches:
            for name, first, last in zip(b["name"].to_pylist(), b["first"].to_pylist(), b["last"].to_pylist(), strict=True):
                if coder is None or ct.entry_name(coder.entry) != name:
                    coder = FrameCoder(parse_name(name))
                frames = [coder.frame(k) for k in range(first, last)]
                text = ",".join(canonical(frame_json(coder.scene, k, coder.walks)) for k in range(first, last))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([[len(f) for f in frames]], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary()), pa.array([text])], ["name", "first", "sizes", "media", "manifest"])

    dealt = ranges.repartition(n, SF.xxhash64("name", "first"))
    return dealt.mapInArrow(run, "name string, first long, sizes array<long>, media binary, manifest string")


def artifact_bytes(entries: DataFrame) -> DataFrame:
    """(name, content, error): two files per entry, its manifest and its media.

    Ranges meet per entry, at most about 30 MB by the catalogue's cap on pixels times frames.  What
    fails in one entry is told in its row and leaves the others alone.
    """

    def run(key, table):
        name = key[0].as_py()
        rows = sorted(zip(table["first"].to_pylist(), table["sizes"].to_pylist(), table["media"].to_pylist(), table["manifest"].to_pylist(), strict=True))
        try:
            e = parse_name(name)
            head = canonical(head_json(name, e, ct.scene_of(e)) | {"frames": []})
            text = head.replace('"frames":[]', '"frames":[' + ",".join(r[3] for r in rows) + "]", 1)
            frames, at = [], 0
            for _, sizes, data, _ in rows:
                at = 0
                for n in sizes:
                    frames.append(data[at : at + n])
                    at += n
            out = [(f"{name}.json", text.encode(), None), (ct.media_name(e), mux(e, frames), None)]
        except (ValueError, ArithmeticError) as err:
            out = [(name, None, f"{type(err).__name__}: {err}")]
        return pa.table({"name": pa.array([o[0] for o in out], pa.string()), "content": pa.array([o[1] for o in out], pa.binary()), "error": pa.array([o[2] for o in out], pa.string())})

    return encoded_ranges(entries).groupBy("name").applyInArrow(run, "name string, content binary, error string")


def artifacts(entries: DataFrame) -> DataFrame:
    """(name, digest, length) of all artifacts; digests are taken in the task that builds the bytes."""
    from framewright.operators.lockfile import digests

    return digests(artifact_bytes(entries).where("error is null"))


def select_entries(entries: DataFrame, only: list[str] | DataFrame, strict: bool = False) -> DataFrame:
    """Entries by name, all if an empty list asks for none; with ``strict`` a name that there is not raises.

    Names are a list, which is broadcast, or the column ``name`` of a table, which is joined.
    """
    if isinstance(only, list):
        if not only:
            return entries
        want = SF.broadcast(entries.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(only)], "name string"))
    else:
        want = only.select("name").distinct()
    if strict and (unknown := [r[0] for r in want.join(entries, "name", "left_anti").limit(10).collect()]):
        raise ValueError(f"no entry is called {', '.join(sorted(unknown))}")
    return entries.join(want, "name", "left_semi").select(entries.columns)


def publish(entries: DataFrame, out_dir: str, dry_run: bool = False) -> DataFrame:
    """Write each artifact to ``out_dir`` under its name; (name, length, error), one row a file.

    A file is written beside its place and moved there when whole, so that no reader meets half of
    one.  With ``dry_run`` all is made and nothing written.  ``out_dir`` is any URI that Arrow's file
    systems know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(out_dir) if "://" in out_dir else (fs.LocalFileSystem(), out_dir)
        if not dry_run:
            place.create_dir(base, recursive=True)
        for b in batches:
            errors = []
            for name, content, error in zip(b["name"].to_pylist(), b["content"].to_pylist(), b["error"].to_pylist(), strict=True):
                if error is None and not dry_run:
                    try:
                        with place.open_output_stream(f"{base}/{name}.tmp") as f:
                            f.write(content)
                        place.move(f"{base}/{name}.tmp", f"{base}/{name}")
                    except OSError as err:
                        error = str(err)
                        # nothing half written stays behind
                        with contextlib.suppress(OSError):
                            place.delete_file(f"{base}/{name}.tmp")
                errors.append(error)
            lengths = [None if x is None else len(x) for x in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(lengths, pa.int64()), pa.array(errors, pa.string())], ["name", "length", "error"])

    return artifact_bytes(entries).mapInArrow(run, "name string, length long, error string")
