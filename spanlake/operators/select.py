"""Selection of events by path patterns, grouping under a parent, and search.

A pattern is names joined by ``/``: ``*`` stands for one level, ``**`` for any number, a leading ``.`` anchors at the
root; without it a pattern matches the end of a path. Patterns are compiled once to a regular expression, which meets
each event's path where it stands, so that the events are planned once and not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["stream_id", "thread_id"]
SEP = "\u0001"


@dataclass(frozen=True)
class EventSpec:
    """Which events: patterns of their paths, of their thread's name, and of a parent scope's path."""

    events: tuple[str, ...] = field(default_factory=tuple)
    thread: str | None = None
    parent: str | None = None

    def __post_init__(self):
        if isinstance(self.events, str):
            object.__setattr__(self, "events", (self.events,))


def pattern_regex(pattern: str, at_root: bool = True) -> str:
    """An anchored regular expression over names joined by ``SEP``; a leading ``.`` counts only with ``at_root``."""
    names = [x for x in pattern.strip().split("/") if x]
    anchored = bool(names) and names[0] == "."
    if anchored:
        names = names[1:]
    elif names and names[0].startswith(".") and len(names[0]) > 1:
        anchored, names = True, [names[0][1:], *names[1:]]
    out = "" if anchored and at_root else f"(?:[^{SEP}]*{SEP})*"
    for i, n in enumerate(names):
        last = i == len(names) - 1
        if n == "**":
            out += f"[^{SEP}]*(?:{SEP}[^{SEP}]*)*" if last else f"(?:[^{SEP}]*{SEP})*"
        else:
            body = "[^" + SEP + "]*" if n == "*" else "\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            out += body + ("" if last else SEP)
    return f"^{out}$"


def _joined(path: str = "path") -> Column:
    return F.array_join(path, SEP)


def _prefix_matches(regex: str):
    return lambda k: F.array_join(F.slice("path", F.lit(1), k), SEP).rlike(regex) & (k < F.size("path"))


def matching_paths(paths: DataFrame, specs: list[EventSpec]) -> DataFrame:
    """``(spec_id, path)`` of the distinct paths that match a spec's event patterns."""
    return paths.select("path").distinct().select(F.explode(spec_ids(specs)).alias("spec_id"), "path")


def spec_ids(specs: list[EventSpec]) -> Column:
    """The numbers of the specs whose event patterns a row's path matches."""
    return F.array_compact(F.array(*[F.when(F.array_max(F.array(*[_joined().rlike(pattern_regex(e)) for e in s.events])), F.lit(i)) for i, s in enumerate(specs)]))


def select_events(df: DataFrame, specs: list[EventSpec], threads: DataFrame | None = None) -> DataFrame:
    """Events of ``df(stream_id, thread_id, seq, path, scope_path, ...)`` by spec, one row for each match.

    ``parent_match`` is the root-most enclosing scope that matches the spec's parent pattern; with a parent pattern
    only events that have one are kept. ``threads(stream_id, thread_id, name)`` is needed for thread patterns.
    """
    return keep_matches(df.withColumn("spec_id", F.explode(spec_ids(specs))), specs, threads)


def keep_matches(hit: DataFrame, specs: list[EventSpec], threads: DataFrame | None = None) -> DataFrame:
    """Of rows with the spec that their path matches, those whose thread and parent match too, with ``parent_match``."""
    if any(s.thread for s in specs):
        rule = F.lit(True)
        for i, s in enumerate(specs):
            if s.thread:
                rule = rule & ((F.col("spec_id") != i) | F.col("thread_name").rlike(pattern_regex(s.thread)))
        hit = hit.join(threads.select(*KEYS, F.col("name").alias("thread_name")), KEYS).where(rule).drop("thread_name")
    at = F.lit(None).cast("int")
    for i, s in enumerate(specs):
        if s.parent:
            hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("scope_path"), F.lit(1))), _prefix_matches(pattern_regex(s.parent)))
            at = F.when(F.col("spec_id") == i, F.when(F.size("scope_path") > 0, F.array_min(hits))).otherwise(at)
    hit = hit.withColumn("_at", at)
    needs = [i for i, s in enumerate(specs) if s.parent]
    if needs:
        hit = hit.where(~F.col("spec_id").isin(needs) | F.col("_at").isNotNull())
    return hit.withColumn("parent_match", F.when(F.col("_at").isNotNull(), F.get("scope_path", F.col("_at") - 1))).drop("_at")


def group_under_parent(selected: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row for each parent instance with its matching events in arrival order; the value is the parent's duration."""
    kids = selected.where("parent_match is not null").groupBy("spec_id", *KEYS, F.col("parent_match").alias("scope_id")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", F.element_at("path", -1).alias("name")))).alias("children")
    )
    return kids.join(scopes.select(*KEYS, "scope_id", "name", "duration_ns"), [*KEYS, "scope_id"])


STAGES = ("no events", "unknown thread", "unknown event name", "event path not found", "not at the event's root", "unknown parent name", "parent path not found", "not at the parent's root", "parents differ", "resolved")
_FAILS = {"thread": 1, "name": 2, "path": 3, "root": 4, "pname": 5, "ppath": 6, "proot": 7, "under": 8}


def explain_unresolved(df: DataFrame, specs: list[EventSpec], threads: DataFrame | None = None) -> DataFrame:
    """``(spec_id, event, stage, reason)``: for each spec and event pattern how far its resolution comes (``STAGES``).

    A parent is asked for on the spec's threads; "parents differ" says that the parent is there, but no event of the
    pattern stands below it. ``threads(stream_id, thread_id, name)`` is needed for thread patterns. The flags are
    aggregated over the distinct threads and paths.
    """
    scope = F.size("path") == F.size("scope_path")
    p = df.select(*KEYS, "path", scope.alias("_scope")).distinct().withColumn("_p", _joined())
    if any(s.thread for s in specs):
        p = p.join(threads.select(*KEYS, F.col("name").alias("_thread")), KEYS, "left")
    flags, rows = [], []
    for i, s in enumerate(specs):
        on = F.coalesce(F.col("_thread").rlike(pattern_regex(s.thread)), F.lit(False)) if s.thread else F.lit(True)
        for j, e in enumerate(s.events):
            tests = {"thread": on, "name": on & _leaf(e), "path": on & F.col("_p").rlike(pattern_regex(e, False)), "root": on & F.col("_p").rlike(pattern_regex(e))}
            if s.parent:
                above = F.filter(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), _prefix_matches(pattern_regex(s.parent)))
                here = on & F.col("_scope")
                tests |= {"pname": here & _leaf(s.parent), "ppath": here & F.col("_p").rlike(pattern_regex(s.parent, False)), "proot": here & F.col("_p").rlike(pattern_regex(s.parent)), "under": tests["root"] & (F.size(above) > 0)}
            flags += [F.max(c).alias(f"_{i}_{j}_{k}") for k, c in tests.items()]
            stage = F.when(F.col("_n") == 0, 0)
            for k, name in enumerate(tests):
                stage = stage.when(~F.coalesce(F.col(f"_{i}_{j}_{name}"), F.lit(False)), _FAILS[name])
            stage = stage.otherwise(len(STAGES) - 1)
            rows.append(F.struct(F.lit(i).alias("spec_id"), F.lit(e).alias("event"), stage.cast("int").alias("stage")))
    told = p.agg(F.count("*").alias("_n"), *flags).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return told.withColumn("reason", F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("stage") + 1))


def _leaf(pattern: str) -> Column:
    """Whether a path ends with the pattern's last name."""
    leaf = [x for x in pattern.split("/") if x][-1].lstrip(".")
    return F.lit(True) if leaf in ("*", "**", "") else F.element_at("path", -1) == leaf


def collect_until(selected: DataFrame, wanted: list[int] | None = None, unwanted: list[int] | None = None, max_events: int | None = None) -> DataFrame:
    """Selected events up to the first row at which all ``wanted`` specs were seen or an ``unwanted`` one was, and at
    most ``max_events`` in arrival order."""
    firsts = selected.groupBy("spec_id").agg(F.min("seq").alias("first"))
    stop = F.lit(None).cast("long")
    if wanted:
        seen = firsts.where(F.col("spec_id").isin(wanted)).agg(F.count("*").alias("n"), F.max("first").alias("at"))
        stop = F.least(stop, F.when(F.col("w.n") == len(wanted), F.col("w.at")))
    if unwanted:
        stop = F.least(stop, F.col("u.at"))
    out = selected
    if wanted:
        out = out.join(F.broadcast(seen.select(F.struct("n", "at").alias("w"))))  # one row
    if unwanted:
        out = out.join(F.broadcast(firsts.where(F.col("spec_id").isin(unwanted)).agg(F.min("first").alias("at")).select(F.struct("at").alias("u"))))
    out = out.where(stop.isNull() | (F.col("seq") <= stop)).drop("w", "u").orderBy("seq", "spec_id")
    return out if max_events is None else out.limit(max_events)


def complete(df: DataFrame, text: str, case_sensitive: bool = False, threads: list[int] | None = None, n: int = 30) -> DataFrame:
    d = df if threads is None else df.where(F.col("thread_id").isin(threads))
    name = F.col("name") if case_sensitive else F.lower("name")
    return d.where(name.contains(text if case_sensitive else text.lower())).select("name").distinct().orderBy("name").limit(n)


def search(df: DataFrame, name: str, threads: list[int] | None = None, from_ns: int = 0, n: int | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Occurrences of a name in time order: names of events, string values (of kind ``string``) where ``df`` has a
    ``v_string``, and logs of that category or message (of kind ``log``)."""
    found = df.select(*KEYS, "seq", "date_ns", "kind", "name").where(F.col("name") == name)
    if "v_string" in df.columns:
        found = found.unionByName(df.select(*KEYS, "seq", "date_ns", F.lit("string").alias("kind"), F.col("v_string").alias("name")).where(F.col("name") == name))
    if logs is not None:
        hit = (F.col("category") == name) | (F.col("message") == name)
        found = found.unionByName(logs.where(hit).select(*KEYS, "seq", "date_ns", F.lit("log").alias("kind"), F.lit(name).alias("name")))
    d = found.where(F.col("date_ns") >= from_ns)
    d = d if threads is None else d.where(F.col("thread_id").isin(threads))
    d = d.orderBy("date_ns", "seq")
    return d if n is None else d.limit(n)

