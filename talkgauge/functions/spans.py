"""Where a pattern matches in a text: positions that SQL's regular expression functions don't give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<start:int,end:int,value:string>>"
#: Matches that are folded together before they are appended to the result.
_BLOCK = 512


def none() -> Column:
    """No places."""
    return F.from_json(F.lit("[]"), PLACES)


def _last(text: Column, n: int) -> Column:
    """The last n characters."""
    return F.substring(text, -n, n)


def let(value: Column, make) -> Column:
    """What ``make`` makes of ``value``, which is evaluated once however often it is used there."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def places(text: Column, pattern: str, context: int = 0) -> Column:
    """Where ``pattern`` (Java's syntax) matches: (start, end, value) in code points, end exclusive.

    With ``context``, also before: so many characters that stand before the match (fewer at the text's start).

    Matches and the text between them alternate, so positions are running sums of lengths, and what stands before a match is
    the end of what has been passed. The sums are folded in blocks: a text with very many matches costs little more
    than its matches, and no match looks at the text from its start.
    """
    ends = (lambda gap: [_last(gap, context).alias("passed")]) if context else (lambda gap: [])
    kind = PLACES.replace(">>", ",before:string>>") if context else PLACES
    nothing = F.from_json(F.lit("[]"), kind)

    def begin(pos: Column, tail: Column) -> Column:
        return F.struct(pos.alias("pos"), *([tail.alias("tail")] if context else []), nothing.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["value"])
        own = [start.alias("start"), end.alias("end"), x["value"].alias("value")]
        if not context:
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(*own))).alias("out"))
        before = _last(F.concat(acc["tail"], x["passed"]), context)
        held = F.array(F.struct(*own, before.alias("before")))
        return F.struct(end.alias("pos"), _last(F.concat(before, x["value"]), context).alias("tail"), F.concat(acc["out"], held).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, begin(acc["pos"], acc["tail"] if context else F.lit("")), step)
        tail = [own["tail"].alias("tail")] if context else []
        return F.struct(own["pos"].alias("pos"), *tail, F.concat(acc["out"], own["out"]).alias("out"))

    def folded(steps: Column) -> Column:
        n = F.size(steps)
        blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)), lambda at: F.slice(steps, at + 1, F.least(F.lit(_BLOCK), n - at)))
        return F.aggregate(blocks, begin(F.lit(0), F.lit("")), block, lambda acc: acc["out"])

    def of(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"), *ends(gap)))
        return F.when(F.size(found) > 0, let(F.slice(steps, 1, F.size(found)), folded)).otherwise(nothing)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
