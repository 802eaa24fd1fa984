"""Scalar building blocks: text normalisation, identifiers, boxes, keyed hashes. All are Spark columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.schemas import SSN_SHAPE


def let(value: Column, body) -> Column:
    """Binds `value` to a name, so that it is computed once: expressions are otherwise inlined wherever used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(**columns: Column) -> Column:
    """The columns as one struct from a generator. What a generator yields stands in the plan as it is, where a projection's
    columns are written out again wherever a lambda reads them, and so computed for each element."""
    return F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def norm(token: Column) -> Column:
    """Lower case, and nothing but letters, digits and mask signs."""
    return F.regexp_replace(F.lower(token), "[^a-z0-9*x•]", "")


def target(value: Column) -> Column:
    """A value to look for: no white space of any kind, then `norm`."""
    return norm(F.regexp_replace(value, "(?U)\\s+", ""))


def fragments(value: Column, least: int = 5) -> Column:
    """The parts of a value between commas, newlines and wide gaps, trimmed, of `least` characters."""
    return F.filter(F.transform(F.split(value, "(?U)\\s{2,}|,|\\n"), strip), lambda x: F.length(x) >= least)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def ssn_token(text: Column) -> Column:
    return F.btrim(text, F.lit(".,;:()"))


def ssn_like(token: Column) -> Column:
    """Shape 3-2-4 of digits or mask signs with at least one digit; digits of any script."""
    return token.rlike("(?U)" + SSN_SHAPE) & token.rlike("(?U)\\d")


def ssn_possible(text: Column) -> Column:
    """Whether words joined to a text may hold an identifier, in one word or in two: none is anywhere else. What `ssn_token`
    takes off, and the space between words, may stand at either side of its dashes."""
    gap = "[.,;:()\\s]*"
    return text.rlike(gap.join(["(?U)[\\dxX*•]{3}", "[-–]", "[\\dxX*•]{2}", "[-–]", "[\\dxX*•]{4}"]))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def _thousandths(v: Column, extent: Column) -> Column:
    return F.rint(1000 * v / extent).cast("int")


def normalized_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Thousandths of the page, rounded half to even, within it, at least one wide and high."""
    left = F.greatest(F.lit(0), F.least(F.lit(999), _thousandths(x1, width)))
    top = F.greatest(F.lit(0), F.least(F.lit(999), _thousandths(y1, height)))
    right = F.greatest(left + 1, F.least(F.lit(1000), _thousandths(x2, width)))
    bottom = F.greatest(top + 1, F.least(F.lit(1000), _thousandths(y2, height)))
    return box(left, top, right, bottom)


def rotated_box(b: Column, rotation: Column) -> Column:
    """Where a box lands after a clockwise turn of the page by 0, 90, 180 or 270 degrees."""
    x1, y1, x2, y2 = (b[k] for k in ("x1", "y1", "x2", "y2"))
    return (
        F.when(rotation == 90, box(1000 - y2, x1, 1000 - y1, x2))
        .when(rotation == 180, box(1000 - x2, 1000 - y2, 1000 - x1, 1000 - y1))
        .when(rotation == 270, box(y1, 1000 - x2, y2, 1000 - x1))
        .otherwise(box(x1, y1, x2, y2))
    )


def pixel_box(b: Column, width: Column, height: Column, padding: int = 3) -> Column:
    def at(v: Column, extent: Column) -> Column:
        return F.rint(v * extent / F.lit(1000.0)).cast("int")

    return box(
        F.greatest(F.lit(0), at(b["x1"], width) - padding),
        F.greatest(F.lit(0), at(b["y1"], height) - padding),
        F.least(width.cast("int"), at(b["x2"], width) + padding),
        F.least(height.cast("int"), at(b["y2"], height) + padding),
    )


def valid_box(b: Column) -> Column:
    """Within the page and of positive area."""
    return b["x1"].between(0, 999) & b["y1"].between(0, 999) & b["x2"].between(1, 1000) & b["y2"].between(1, 1000) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def degenerate_box(b: Column, least: int = 2) -> Column:
    return (b["x2"] - b["x1"] < least) | (b["y2"] - b["y1"] < least)


def touches(a: Column, b: Column) -> Column:
    """Closed boxes that share a point."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def keyed_hash(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex, of nested SHA-256. The key's pads stand in the plan: use a key meant for that."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def client_fingerprint(ip: Column, key: bytes) -> Column:
    return F.left(keyed_hash(F.concat(F.lit("client:"), ip), key), F.lit(32))


def content_fingerprint(text: Column, key: bytes) -> Column:
    folded = F.btrim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "(?U)\\s+", " "))
    return F.left(keyed_hash(F.concat(F.lit("content:"), folded), key), F.lit(16))


def detection_id(*parts: Column | str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256), F.lit(32))


def page_band(pages: Column) -> Column:
    return F.when(pages == 1, "single").when(pages <= 5, "short").when(pages <= 20, "medium").otherwise("long")


def redacted_name(label: Column) -> Column:
    """`dir/name.ext` to `name-redacted.pdf`, with safe characters only."""
    stem = F.regexp_replace(F.regexp_extract(label, "[^\\\\/]*$", 0), "\\.[^.]+$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[\\\\/:*?\"<>|]+", "-"), "\\s+", " ")
    safe = F.left(F.regexp_replace(safe, "^[-. ]+|[-. ]+$", ""), F.lit(120))
    return F.concat(F.when(F.length(safe) > 0, safe).otherwise("document"), F.lit("-redacted.pdf"))
