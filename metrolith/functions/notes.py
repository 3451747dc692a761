"""Notes: reading one from notation, its tokens, its end, its text, and what it may look like. All as columns.

A note is one flat struct whatever its type; fields that a type doesn't have are null. Reading never raises: what can't be
read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions import durations as D
from metrolith.functions import vocabulary as V
from metrolith.functions.quantize import centiseconds, time_token

SEGMENT = "struct<shape:string,start_lane:int,end_lane:int,wait_sec:double,trace_sec:double,cw:boolean,middle_lane:int,force_star:boolean,fake_rotate:boolean,slide_break:boolean,no_head:boolean>"
NOTE = f"struct<type:string,lane:int,area:string,hold_sec:double,firework:boolean,segments:array<{SEGMENT}>,is_break:boolean,is_ex:boolean>"

_MARKS = r"[@$xb?!]*"
_SHAPE = r"pp|qq|[-<>^vVpqszw]"
#: One segment: marks, a new branch with its own marks, a shape (left out: that of the segment before), lanes, a bracket.
_PIECE = rf"({_MARKS})(?:(\*)({_MARKS}))?(?:(V)([bx]*)([1-8])([1-8])|(pp|qq|[-<>^vpqszw])([bx]*)([1-8])|([1-8]))([bx]*)(?:\[([^\]]*)\])?([bx]*)"
_PLAIN = _PIECE.replace("(?:", "\x00").replace("(", "(?:").replace("\x00", "(?:")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _flag(mark: str, *texts: Column) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | t.contains(mark)
    return out


def _force_star(marks: Column) -> Column:
    """A `$` that is left when the others of its run make pairs."""
    return F.coalesce(marks, F.lit("")).rlike(r"(?<!\$)(?:\$\$)*\$(?!\$)")


def slide_parts(token: Column, bpm: Column, strict: bool = False) -> Column:
    """The segments of a slide as they are written, each with what it says itself; null if the token isn't a slide."""
    default = F.struct(D.whole(bpm).alias("wait"), F.lit(0.0).alias("trace"))
    body = F.regexp_replace(F.when(token.endswith("b") & ~token.endswith("hb"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token), r"^[?!]", "")
    fits = body.rlike(rf"^[1-8]{_MARKS}(?:{_PLAIN})+$")
    rest = F.regexp_replace(body, r"^[1-8]", "")
    part = lambda p, i: F.regexp_extract(p, f"^{_PIECE}", i)

    def read(p: Column) -> Column:
        marks = F.concat(part(p, 1), F.lit(" "), part(p, 3))
        shape = F.concat(part(p, 4), part(p, 8))
        tail = F.concat(part(p, 5), part(p, 9), part(p, 12), part(p, 14))
        return F.struct(
            marks.alias("marks"),
            (part(p, 2) == "*").alias("branch"),
            F.when(shape != "", shape).alias("shape"),
            F.when(part(p, 6) != "", part(p, 6)).alias("middle"),
            F.concat(part(p, 7), part(p, 10), part(p, 11)).alias("digit"),
            tail.alias("tail"),
            p.contains("[").alias("timed"),
            F.when(p.contains("["), D.slide_times(part(p, 13), bpm, strict)).otherwise(default).alias("times"),
        )

    return F.when(fits, F.transform(F.regexp_extract_all(rest, F.lit(_PLAIN), 0), read))


def slide_segments(token: Column, parts: Column) -> Column:
    """The segments as an array of SEGMENT; null where a shape or lane is missing, or a time can't be read. Marks hold from
    where they stand for all segments that follow; a break at the end of the token holds for all."""
    first = F.substring(F.regexp_replace(token, r"^[?!]", ""), 1, 1)
    all_break = token.endswith("b") & ~token.endswith("hb")
    headless = token.rlike(r"^[?!]")
    upto = lambda i: F.slice(parts, F.lit(1), i + 1)
    shape_at = lambda i: F.try_element_at(F.filter(upto(i), lambda p: p["shape"].isNotNull()), F.lit(-1))["shape"]
    last_shaped = lambda i: F.array_max(F.transform(upto(i), lambda p, k: F.when(p["shape"].isNotNull(), k)))
    # After a shape with a middle lane, left-out shapes take two lanes each, which were cut as two pieces.
    bare = lambda i: F.when(shape_at(i) == "V", i - last_shaped(i)).otherwise(F.lit(0))

    def build(p: Column, i: Column) -> Column:
        seen, two = upto(i), bare(i) > 0
        begin = F.when(two, i - 1).otherwise(i)  # where this segment's own text starts
        branch = F.get(parts, begin)["branch"] | (begin == 0)
        start = F.when(branch, first).otherwise(F.get(parts, begin - 1)["digit"])
        shape = shape_at(i)
        some = lambda test: F.exists(seen, test)
        return F.struct(
            F.create_map(*[F.lit(x) for pair in V.SHAPE_OF.items() for x in pair])[shape].alias("shape"),
            start.cast("int").alias("start_lane"),
            p["digit"].cast("int").alias("end_lane"),
            p["times"]["wait"].alias("wait_sec"),
            p["times"]["trace"].alias("trace_sec"),
            F.when(shape == ">", F.lit(True)).when(shape == "<", F.lit(False)).alias("cw"),
            F.when(two, F.get(parts, i - 1)["digit"]).otherwise(p["middle"]).cast("int").alias("middle_lane"),
            some(lambda q: _force_star(q["marks"])).alias("force_star"),
            some(lambda q: q["marks"].contains("$$")).alias("fake_rotate"),
            (all_break | some(lambda q: _flag("b", q["marks"], q["tail"]))).alias("slide_break"),
            (headless | some(lambda q: _flag("@", q["marks"]) | q["marks"].rlike("[?!]"))).alias("no_head"),
        )

    # Pieces that only hold a middle lane: nothing may stand around it, and its second half must follow at once.
    half = lambda i: bare(i) % 2 == 1
    odd = F.transform(parts, lambda p, i: F.when(half(i), (p["tail"] == "") & ~p["timed"] & (i + 1 < F.size(parts)) & F.coalesce(F.trim(F.get(parts, i + 1)["marks"]) == "", F.lit(False)) & ~F.coalesce(F.get(parts, i + 1)["branch"], F.lit(True)) & F.get(parts, i + 1)["shape"].isNull()).otherwise(F.lit(True)))
    built = F.transform(parts, lambda p, i: F.when(~half(i), build(p, i)))
    whole = F.forall(odd, lambda x: x) & F.get(parts, F.lit(0))["shape"].isNotNull()
    read = lambda b: F.forall(b, lambda s: s["wait_sec"].isNotNull() & s["trace_sec"].isNotNull())
    return F.when(whole, D.let(F.filter(built, lambda s: s.isNotNull()), lambda b: F.when(read(b), b)))


def columns(token: Column, bpm: Column, parts: Column, segments: Column) -> dict[str, Column]:
    """The fields of a note, its `warning` (a kind, or null) and `valid`, from a token that stands for one note.

    Dispatch: a touch area first, then any shape makes a slide, then an `h` a hold, then a tap."""
    head = F.substring(token, 1, 1)
    touch, slide = head.rlike("[A-E]"), token.rlike(_SHAPE)
    held = token.contains("h")
    bracket = F.regexp_extract(token, r"\[([^\]]+)\]", 1)
    timed = held & token.rlike(r"\[[^\]]+\]")
    area = F.when(F.substring(token, 2, 1).rlike(r"^\d$"), F.substring(token, 1, 2)).otherwise(head)
    area = F.when(area.isin("C", "C1", "C2"), F.lit("C")).when(area.isin(V.AREAS), area)
    bare_tap = F.regexp_replace(token, r"\[[^\]]+\]$", "")
    kind = F.when(touch, F.when(timed, F.lit("TOUCH_HOLD")).otherwise(F.lit("TOUCH"))).when(slide, F.lit("SLIDE")).when(timed, F.lit("HOLD")).otherwise(F.lit("TAP"))
    hold = D.seconds(bracket, bpm)
    lane = F.when(head.rlike("[1-8]"), head.cast("int"))
    slide_ex = F.exists(parts, lambda p: _flag("x", p["marks"], p["tail"]))
    slide_break = F.try_element_at(segments, F.lit(-1))["slide_break"]
    last_break = slide_break | F.exists(parts, lambda p: _flag("b", p["marks"], p["tail"]))
    flags = lambda mark: ~touch & F.when(slide, F.coalesce(slide_ex if mark == "x" else last_break, F.lit(False))).otherwise(token.contains(mark))
    valid = (
        F.when(touch, area.isNotNull() & (~timed | hold.isNotNull()))
        .when(slide, segments.isNotNull())
        .when(held, lane.isNotNull() & (~timed | hold.isNotNull()))
        .otherwise(lane.isNotNull() & bare_tap.rlike(r"^[1-8][bx$]*$"))
    )
    warning = (
        F.when(touch, F.when(held & ~timed, F.lit("pseudo-touch-hold")))
        .when(slide, F.when(F.exists(parts, lambda p: p["shape"].isNull()), F.lit("missing-slide-shape")))
        .when(held, F.when(~timed, F.lit("pseudo-hold")))
        .otherwise(F.when(bare_tap != token, F.lit("tap-duration")).when(token.contains("$"), F.lit("star-tap")))
    )
    return {
        "type": kind,
        "lane": F.when(~touch & ~slide, lane),
        "area": F.when(touch, area),
        "hold_sec": F.when((touch | (held & ~slide)) & timed, hold),
        "firework": F.when(touch, token.contains("f")),
        "segments": F.when(~touch & slide, segments),
        "is_break": flags("b"),
        "is_ex": flags("x"),
        "warning": warning,
        "valid": F.coalesce(valid, F.lit(False)),
    }


def as_struct() -> Column:
    """The columns of that name as one NOTE."""
    return F.struct("type", "lane", "area", "hold_sec", "firework", "segments", "is_break", "is_ex").cast(NOTE)


def _if(condition: Column, *tokens) -> Column:
    return F.when(condition, F.array(*[t if isinstance(t, Column) else F.lit(t) for t in tokens])).otherwise(F.array().cast("array<int>"))


def _some(*tokens) -> Column:
    return F.array(*[(t if isinstance(t, Column) else F.lit(t)).cast("int") for t in tokens])


def area_token(area: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in V.AREAS]), area).cast("int") + (V.TOUCH_BASE - 1)


def shape_token(shape: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.SHAPES]), shape).cast("int") + (V.SHAPE_BASE - 1)


def lane_token(lane: Column) -> Column:
    return lane + (V.LANE_BASE - 1)


def segment_tokens(s: Column, i: Column) -> Column:
    """Marks of the head are only written for the first segment."""
    head = i == 0
    return F.concat(
        _some(V.SEGMENT_START, shape_token(s["shape"]), lane_token(s["start_lane"]), lane_token(s["end_lane"])),
        _if(s["middle_lane"].isNotNull(), lane_token(s["middle_lane"])),
        _some(time_token(s["wait_sec"]), time_token(s["trace_sec"])),
        _if(F.coalesce(s["cw"], F.lit(False)), V.IS_CW),
        _if(F.coalesce(~s["cw"], F.lit(False)), V.IS_CCW),
        _if(head & s["force_star"], V.IS_FORCE_STAR),
        _if(head & s["fake_rotate"], V.IS_FAKE_ROTATE),
        _if(s["slide_break"], V.IS_SLIDE_BREAK),
        _if(head & s["no_head"], V.IS_NO_HEAD),
        _some(V.SEGMENT_END),
    )


def note_tokens(n: Column) -> Column:
    marks = F.concat(_if(n["is_break"], V.IS_BREAK), _if(n["is_ex"], V.IS_EX))
    spark = _if(F.coalesce(n["firework"], F.lit(False)), V.IS_FIREWORK)
    slide = F.flatten(F.transform(n["segments"], segment_tokens))
    return (
        F.when(n["type"] == "TAP", F.concat(_some(V.NOTE_TAP, lane_token(n["lane"])), marks))
        .when(n["type"] == "HOLD", F.concat(_some(V.NOTE_HOLD, lane_token(n["lane"]), time_token(n["hold_sec"])), marks))
        .when(n["type"] == "TOUCH", F.concat(_some(V.NOTE_TOUCH, area_token(n["area"])), spark))
        .when(n["type"] == "TOUCH_HOLD", F.concat(_some(V.NOTE_TOUCH, area_token(n["area"]), time_token(F.greatest(n["hold_sec"], F.lit(0.0)))), spark))
        .otherwise(F.concat(_some(V.NOTE_SLIDE), marks, slide))
    )


def frame_tokens(time: Column, notes: Column) -> Column:
    return F.concat(_some(V.FRAME_START, time_token(time)), F.flatten(F.transform(notes, note_tokens)), _some(V.FRAME_END))


def note_end(time: Column, n: Column) -> Column:
    """When a note is over, in seconds."""
    slide = F.array_max(F.transform(n["segments"], lambda s: time + s["wait_sec"] + s["trace_sec"]))
    return F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), time + F.coalesce(n["hold_sec"], F.lit(0.0))).when(n["type"] == "SLIDE", F.greatest(time, slide)).otherwise(time)


def press_lane(n: Column) -> Column:
    """The lane that is pressed, null for touches and for slides without a head."""
    first = F.get(n["segments"], F.lit(0))
    return F.when(n["type"].isin("TAP", "HOLD"), n["lane"]).when((n["type"] == "SLIDE") & ~first["no_head"], first["start_lane"])


def match_key(n: Column) -> Column:
    """What must be equal for two notes to match: type, durations in centiseconds, and how each segment moves."""
    ticks = lambda c: F.coalesce(centiseconds(c).cast("string"), F.lit("-"))
    bit = lambda c: F.coalesce(c.cast("int").cast("string"), F.lit("-"))
    segment = lambda s: F.concat_ws("/", s["shape"], ticks(s["wait_sec"]), ticks(s["trace_sec"]), bit(s["cw"]), bit(s["force_star"]), bit(s["fake_rotate"]), bit(s["no_head"]))
    more = F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), ticks(n["hold_sec"])).when(n["type"] == "SLIDE", F.array_join(F.transform(n["segments"], segment), "|")).otherwise(F.lit(""))
    return F.concat_ws(":", n["type"], more)


def _written_slide(n: Column, bpm: float) -> Column:
    segments = n["segments"]
    shape = F.create_map(*[F.lit(x) for mark, name in V.SHAPE_OF.items() if name != "Circle" for x in (name, mark)])
    mark = lambda s: F.when(s["shape"] == "Circle", F.when(s["cw"], ">").when(~s["cw"], "<").otherwise("^")).otherwise(shape[s["shape"]])
    first = F.get(segments, F.lit(0))
    lead = F.concat(first["start_lane"].cast("string"), F.when(n["is_ex"], "x").otherwise(""), F.when(first["no_head"], "?").otherwise(""), F.when(first["force_star"], "$").otherwise(""), F.when(first["fake_rotate"], "$$").otherwise(""))

    def one(s: Column, i: Column) -> Column:
        joint = F.when(i == 0, lead).when(s["start_lane"] == F.get(segments, i - 1)["end_lane"], "").when(s["start_lane"] == first["start_lane"], "*").otherwise(s["start_lane"].cast("string"))
        return F.concat(joint, mark(s), F.coalesce(s["middle_lane"].cast("string"), F.lit("")), s["end_lane"].cast("string"), D.slide_written(s["wait_sec"], s["trace_sec"], bpm))

    end = F.when(F.try_element_at(segments, F.lit(-1))["slide_break"], "b").otherwise("")
    return D.let(F.transform(segments, one), lambda texts: F.when(~F.exists(texts, lambda t: t.isNull()), F.concat(F.array_join(texts, ""), end)))


def written(n: Column, bpm: float) -> Column:
    """A note in notation at a bpm; null for a slide that can't be written."""
    marks = F.concat(F.when(n["is_break"], "b").otherwise(""), F.when(n["is_ex"], "x").otherwise(""))
    bracket = F.when(n["hold_sec"] > 0, F.concat(F.lit("["), D.written(n["hold_sec"], bpm), F.lit("]"))).otherwise("")
    spark = F.when(n["firework"], "f").otherwise("")
    return (
        F.when(n["type"] == "TAP", F.concat(n["lane"].cast("string"), marks))
        .when(n["type"] == "HOLD", F.concat(n["lane"].cast("string"), marks, F.lit("h"), bracket))
        .when(n["type"] == "TOUCH", F.concat(n["area"], spark))
        .when(n["type"] == "TOUCH_HOLD", F.concat(n["area"], spark, F.lit("h"), bracket))
        .when(n["type"] == "SLIDE", F.when(F.size(n["segments"]) > 0, _written_slide(n, bpm)).otherwise("?"))
    )


def frame_is_valid(notes: Column) -> Column:
    """Whether a frame keeps the grammar on its own: 1 to 33 notes, two presses at most, nothing twice, slides that can be."""
    lanes = F.filter(F.transform(notes, press_lane), lambda x: x.isNotNull())
    areas = F.filter(F.transform(notes, lambda n: n["area"]), lambda x: x.isNotNull())
    texts = F.transform(notes, lambda n: F.array_join(note_tokens(n), " "))
    once = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    held = F.forall(notes, lambda n: ~n["type"].isin("HOLD", "TOUCH_HOLD") | (n["hold_sec"] > 0))

    def span(s: Column) -> Column:
        step, ok = F.pmod(s["end_lane"] - s["start_lane"], F.lit(8)), F.lit(True)
        for shape, steps in V.SPANS.items():
            ok = F.when(s["shape"] == shape, step.isin(*steps)).otherwise(ok)
        return ok

    def segment(s: Column, i: Column, all_of: Column) -> Column:
        grand = s["shape"] == "GrandV"
        middle = F.when(grand, s["middle_lane"].isNotNull() & (s["middle_lane"] != s["start_lane"]) & (s["middle_lane"] != s["end_lane"])).otherwise(s["middle_lane"].isNull())
        joined = (i == 0) | (s["start_lane"] == F.get(all_of, F.lit(0))["start_lane"]) | (s["start_lane"] == F.get(all_of, i - 1)["end_lane"])
        moves = (time_token(s["wait_sec"]) > V.TS_BASE) | (time_token(s["trace_sec"]) > V.TS_BASE)
        return F.coalesce(span(s) & middle & joined & moves & (s["cw"].isNull() | (s["shape"] == "Circle")), F.lit(False))

    slides = F.forall(notes, lambda n: (n["type"] != "SLIDE") | ((F.size(n["segments"]) > 0) & F.forall(F.transform(n["segments"], lambda s, i: segment(s, i, n["segments"])), lambda x: x)))
    return F.size(notes).between(1, V.MAX_NOTES) & (F.size(lanes) <= V.MAX_PRESSES) & once(lanes) & once(areas) & once(texts) & held & slides


def durations_are_valid(n: Column) -> Column:
    """Holds of 1 to 2999 centiseconds; waits and traces of 0 to 2999, not both 0."""
    top = V.TS_COUNT - 1
    slide = F.forall(n["segments"], lambda s: centiseconds(s["wait_sec"]).between(0, top) & centiseconds(s["trace_sec"]).between(0, top) & (centiseconds(s["wait_sec"]) + centiseconds(s["trace_sec"]) > 0))
    return F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), centiseconds(n["hold_sec"]).between(1, top)).when(n["type"] == "SLIDE", slide & (F.size(n["segments"]) > 0)).otherwise(F.lit(True))
