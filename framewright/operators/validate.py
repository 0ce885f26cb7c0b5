"""What an entry's declaration may hold: alphabets, positive numbers, rates, and what a fault needs."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.operators.lockfile import ENTRY_NAME, FILE_NAME, JSON_KEY


def name_error(name: Column, kind: str) -> Column:
    """Null, or "empty" or "alphabet", for an entry name, a key of JSON or a file name."""
    return F.when(F.length(name) == 0, "empty").when(~name.rlike({"entry": ENTRY_NAME, "key": JSON_KEY, "file": FILE_NAME}[kind]), "alphabet")


def not_positive(num: Column, den: Column | None = None) -> Column:
    """Whether a number, or a fraction with a positive or negative denominator, is not above zero."""
    return (num <= 0) if den is None else (num * F.signum(den) <= 0)


def same_rate(a_num: Column, a_den: Column, b_num: Column, b_den: Column) -> Column:
    """Whether two rates are one number, reduced or not."""
    return a_num * b_den == b_num * a_den


def spec_error(coding: Column, container: Column, defect: Column) -> Column:
    """Null, or "size-omission": the size may be left out of an ISO container only, and of motion JPEG, which carries its own."""
    return F.when((defect == "no-dim") & ~((coding == "mjpeg") & (container == "iso")), "size-omission")


def declaration_error(c: dict[str, Column]) -> Column:
    """The first fault of a declaration by columns width, height, count, rate, scale, zoom, capture (num and den each) and coding, container, defect.

    A null scale or capture rate is none.
    """
    pair = lambda k: (c[f"{k}_num"], c[f"{k}_den"])
    return (
        F.when(not_positive(c["width"]), "width").when(not_positive(c["height"]), "height").when(not_positive(c["count"]), "count")
        .when(not_positive(*pair("rate")), "rate").when(not_positive(*pair("scale")), "scale").when(not_positive(*pair("zoom")), "magnification")
        .when(not_positive(*pair("capture")), "capture rate").when(same_rate(*pair("capture"), *pair("rate")), "capture equals playback")
        .otherwise(spec_error(c["coding"], c["container"], c["defect"]))
    )


def check_entry(e: dict, rate: Fraction) -> None:
    """The same for one parsed entry; ValueError where it must not be made."""
    if min(*e["dimensions"], e["frame_count"]) < 1:
        raise ValueError("width, height and count are at least 1")
    if max(e["dimensions"]) > 0xFFFF:
        raise ValueError("width and height fit 16 bits")
    if e["capture"] and e["capture"][0] <= 0:
        raise ValueError("a capture rate is above zero")
    if e["capture"] and e["capture"][0] == rate:
        raise ValueError("a capture rate differs from the playback rate")
    if e["capture"] and e["container"] != "iso":
        raise ValueError("only ISO files tell a capture rate")
    if e["defect"] == "no-dim" and (e["coding"], e["container"]) != ("mjpeg", "iso"):
        raise ValueError("only motion JPEG in an ISO file can leave its size out")
