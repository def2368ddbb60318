"""Paths of chosen files: whether they stay below a folder, and whether what they name may be replayed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetrace.functions import typed_json as j

# Endings of episode files, sources and modes of a replay, range of its speed.
ENDINGS, SOURCES, MODES, SPEEDS = (".hdf5", ".h5"), ("state", "action"), ("arms", "full"), (0.5, 2.0)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))


def _step(done: Column, segment: Column, links: Column | None) -> Column:
    up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    down = F.concat(done, F.array(segment))
    if links is not None:
        target = F.try_element_at(links, F.concat(F.lit("/"), F.array_join(down, "/")))
        down = F.when(target.isNotNull(), _segments(target)).otherwise(down)
    return F.when(segment == "..", up).otherwise(down)


def resolved(root: Column, relative: Column, links: Column | None = None) -> Column:
    """The segments of a path below ``root``, an absolute path, one after another: ``.`` stays, ``..`` goes up (but not above the top), and a place
    that ``links`` names (a map from absolute path to absolute target, both without further links) is left for its target."""
    steps = F.concat(_segments(root), _segments(relative))
    return F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: _step(done, s, links))


def contained(root: Column, relative: Column, links: Column | None = None) -> Column:
    """The path relative to ``root`` if it is still below it once resolved; null for an absolute, empty or escaping one."""
    top = F.aggregate(_segments(root), F.array().cast("array<string>"), lambda done, s: _step(done, s, links))

    def below(found: Column) -> Column:
        own, whole = found["top"], found["whole"]
        inside = (F.slice(whole, 1, F.size(own)) == own) & (F.size(whole) > F.size(own))
        return F.when(inside, F.array_join(F.slice(whole, F.size(own) + 1, F.greatest(F.size(whole) - F.size(own), F.lit(0))), "/"))

    asked = F.trim(relative)
    found = j.bind(F.struct(top.alias("top"), resolved(root, asked, links).alias("whole")), below)
    return F.when((asked != "") & ~F.startswith(asked, F.lit("/")), found)


def choice_fault(root: Column, relative: Column, source: Column, mode: Column, speed: Column, action_mode: Column, links: Column | None = None) -> Column:
    """The first reason why a chosen episode cannot be replayed, or null. Recorded actions can be only if they are absolute targets."""
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    path = contained(root, relative, links)
    fault = lambda p: j.first_fault(
        (F.coalesce(F.trim(relative) == "", F.lit(True)), "no path"),
        (F.startswith(F.trim(relative), F.lit("/")), "absolute path"),
        (p.isNull(), "outside the folder"),
        (~F.lower(F.coalesce(p, F.lit(""))).rlike(r"[^/](" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"), "no episode file"),
        (~word(source).isin(*SOURCES), "source"),
        (~word(mode).isin(*MODES), "mode"),
        (~F.coalesce(speed.between(*SPEEDS) & ~F.isnan(speed), F.lit(False)), "speed"),
        ((word(source) == "action") & (F.lower(F.coalesce(action_mode, F.lit(""))) != "absolute"), "actions are not absolute"),
    )
    return j.bind(path, fault)
