"""Dependencies against cached lookups and advisory ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.ranking import running_sum
from auditlake.session import cut_lineage

DEP_KEY = ["ecosystem", "name", "version"]
_PART = 20
_FEW_RULES = 64  # of a package, to be compared with each of its versions
_BROADCAST_BYTES = 8 << 20


#: Marks of versions before their release, in order.
PRE_RELEASE = {"dev": 1, "alpha": 2, "a": 2, "beta": 3, "b": 3, "m": 4, "pre": 5, "preview": 5, "rc": 6}
_MARK = "dev|alpha|a|beta|b|m|preview|pre|rc"
_NUMBERS = r"[0-9]+(?:[._-][0-9]+)*"
_BEFORE = rf"^v?{_NUMBERS}[._-]?({_MARK})[._-]?([0-9]*)"


def comparable(version: Column) -> Column:
    """True for dotted numbers, with an optional leading v, pre-release mark and build suffix."""
    number = rf"[0-9]{{1,{_PART}}}"
    return F.lower(version).rlike(rf"^v?{number}([._-]{number})*([._-]?({_MARK})[._-]?[0-9]{{0,{_PART}}})?([+].*)?$")


def version_key(version: Column) -> Column:
    """Order-preserving text of a comparable version; 1.2 and 1.2.0 are equal, pre-releases come before their release."""
    low = F.lower(version)
    numbers = F.regexp_replace(F.regexp_extract(low, rf"^v?({_NUMBERS})", 1), r"([._-]0+)+$", "")
    padded = F.array_join(F.transform(F.split(numbers, r"[._-]"), lambda p: F.lpad(p, _PART, "0")), ".")
    ranks = F.create_map(*[F.lit(x) for mark, rank in PRE_RELEASE.items() for x in (mark, str(rank))])
    rank = F.try_element_at(ranks, F.regexp_extract(low, _BEFORE, 1))
    # "!" sorts before "-", which sorts before the "." of a longer number
    return F.concat(padded, F.coalesce(F.concat(F.lit("!"), rank, F.lpad(F.regexp_extract(low, _BEFORE, 2), _PART, "0")), F.lit("-")))


def cache_key() -> Column:
    return F.concat_ws(":", "ecosystem", "name", "version")


def newest_entry(cache: DataFrame) -> DataFrame:
    """Newest row per key (combined map-side)."""
    w = Window.partitionBy("key").orderBy(F.desc("cached_at"), F.desc("payload"))
    return cache.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def marked_by_cache(wanted: DataFrame, cache: DataFrame, now: Column, *, ttl_hours: int = 24) -> DataFrame:
    """``wanted(key, ...)`` with ``fresh``: whether an entry not older than the TTL answers it; one join."""
    fresh = cache.filter((now - F.col("cached_at")) <= F.expr(f"interval {ttl_hours} hours")).select("key").distinct()
    return wanted.join(fresh.withColumn("fresh", F.lit(True)), "key", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def split_by_cache(wanted: DataFrame, cache: DataFrame, now: Column, *, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``wanted(key, ...)``; entries older than the TTL do not count."""
    both = marked_by_cache(wanted, cache, now, ttl_hours=ttl_hours)
    return both.filter("fresh").drop("fresh"), both.filter("NOT fresh").drop("fresh")


def _intervals(events: Column) -> Column:
    """Affected intervals of one range as keys; one interval with ``unknown`` if an event can't be compared."""
    kinds = ("fixed", "introduced", "last_affected")  # in this order at one version
    told = F.flatten(F.transform(events, lambda e: F.filter(
        F.array(*[F.struct(F.lit(i).alias("kind"), e[k].alias("value")) for i, k in enumerate(kinds)]), lambda x: x["value"].isNotNull())))
    ordered = F.array_sort(F.transform(told, lambda x: F.struct(version_key(x["value"]).alias("key"), x["kind"].alias("kind"))))

    def interval(both: Column) -> Column:
        e, after = both["e"], both["after"]
        return F.struct(
            e["kind"].alias("kind"), e["key"].alias("from"), F.when(after["kind"] == 0, after["key"]).alias("to"),
            F.when(after["kind"] == 2, after["key"]).alias("last"), F.lit(False).alias("unknown"),
        )

    def intervals(bounds: Column) -> Column:  # a lambda's argument is worked out once, an expression in a lambda for every element
        following = F.slice(bounds, F.lit(2), F.greatest(F.size(bounds), F.lit(1)))
        return F.transform(F.arrays_zip(bounds.alias("e"), following.alias("after")), interval)

    nothing = F.lit(None).cast("string")
    open_question = F.array(F.struct(F.lit(1).alias("kind"), nothing.alias("from"), nothing.alias("to"), nothing.alias("last"), F.lit(True).alias("unknown")))
    known = F.forall(told, lambda x: comparable(x["value"]))
    return F.when(known, F.filter(F.flatten(F.transform(F.array(ordered), intervals)), lambda x: x["kind"] == 1)).otherwise(open_question)


def rules(advisories: DataFrame, fields: tuple[Column, ...] = ()) -> DataFrame:
    """One row per affected interval and per listed version of a package, from one read of the advisories.

    Ranges of ECOSYSTEM and SEMVER count, others (commit ranges) do not speak of
    versions.  Events may come in any order.
    """
    per = advisories.select("id", *fields, F.explode("affected").alias("a"))
    ranges = F.filter(F.coalesce("a.ranges", F.array()), lambda r: F.coalesce(r["type"], F.lit("ECOSYSTEM")).isin("ECOSYSTEM", "SEMVER"))
    by_range = F.transform(F.flatten(F.transform(ranges, lambda r: _intervals(r["events"]))), lambda x: F.struct(x["from"], x["to"], x["last"], x["unknown"], F.lit(None).cast("string").alias("listed")))
    nothing = [F.lit(None).cast("string").alias(n) for n in ("from", "to", "last")]
    by_name = F.transform(F.array_compact(F.coalesce("a.versions", F.array().cast("array<string>"))), lambda v: F.struct(*nothing, F.lit(False).alias("unknown"), v.alias("listed")))
    kept = [c for c in per.columns if c != "a"]
    return per.select(*kept, F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), F.explode(F.concat(by_range, by_name)).alias("x")).select(
        *kept, "ecosystem", "name", F.col("x.from").alias("from_key"), F.col("x.to").alias("to_key"), F.col("x.last").alias("last_key"), "x.unknown", "x.listed"
    )


def _display() -> list[Column]:
    fixed = F.filter(
        F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(
            F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>")),
            lambda r: F.transform(r["events"], lambda e: e["fixed"]))))),
        lambda v: v.isNotNull(),
    )
    cvss = F.filter("severity", lambda s: s["type"] == "CVSS_V3")
    return [
        F.coalesce(F.try_element_at("aliases", F.lit(1)), F.col("id"), F.lit("N/A")).alias("cve_id"),
        F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary"),
        F.coalesce(F.col("database_specific.severity"), F.lit("UNKNOWN")).alias("severity"),
        F.try_element_at(cvss, F.lit(1))["score"].alias("cvss_score"),
        F.coalesce(F.try_element_at(fixed, F.lit(1)), F.lit("")).alias("fixed_version"),
        F.coalesce(F.try_element_at("references", F.lit(1))["url"], F.lit("")).alias("url"),
    ]


def flatten_advisories(advisories: DataFrame) -> DataFrame:
    """Display fields of an advisory; first alias, first score, first fix, first link."""
    return advisories.select("id", *_display())


_BOUNDS = ["from_key", "to_key", "last_key"]


def _covered(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, name, _v, bounds): which comparable version keys lie in which intervals of their package.

    A sweep over a package's version keys and interval bounds in one order gives every interval the
    places of its first and its last version, so exactly the hits are made, not all pairs of a
    package; a package of any size is swept in range parts (see ``ranking``).
    """
    package = ["ecosystem", "name"]
    bounds = ranges.select(*package, *_BOUNDS).distinct()
    keys = versions.select(*package, F.col("_v").alias("key")).distinct()
    empty = [F.lit(None).cast("string").alias(b) for b in _BOUNDS]
    after_all = F.lit("~")  # behind every key
    points = keys.select(*package, "key", F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("n"), *empty)
    for key, kind in (
        (F.col("from_key"), F.lit(0)),
        (F.coalesce("to_key", "last_key", after_all), F.when(F.col("to_key").isNotNull(), -1).otherwise(2)),
    ):
        points = points.unionByName(bounds.select(*package, key.alias("key"), kind.alias("kind"), F.lit(0).cast("bigint").alias("n"), *_BOUNDS))
    swept = cut_lineage(running_sum(points, package, ["key", "kind", *_BOUNDS], "n", "place"))
    first, last = F.max(F.when(F.col("kind") == 0, F.col("place") + 1)), F.max(F.when(F.col("kind") != 0, F.col("place")))
    spans = swept.filter("kind != 1").groupBy(*package, *_BOUNDS).agg(first.alias("first"), last.alias("last")).filter(F.col("first") <= F.col("last"))
    inside = spans.select(*package, *_BOUNDS, F.explode(F.sequence("first", "last")).alias("place"))
    return inside.join(swept.filter("kind = 1").select(*package, "place", F.col("key").alias("_v")), [*package, "place"]).drop("place")


def _keyed(dependencies: DataFrame) -> DataFrame:
    """(ecosystem, name, version, _ok, _v): the distinct versions, with keys worked out once for each version text."""
    said = dependencies.select("version").distinct().withColumn("_ok", comparable(F.col("version")))
    said = cut_lineage(said.withColumn("_v", F.when(F.col("_ok"), version_key(F.col("version")))))
    size = said.agg(F.sum(F.octet_length("version") + F.coalesce(F.octet_length("_v"), F.lit(0)) + 64)).first()[0] or 0
    return dependencies.select(*DEP_KEY).distinct().join(F.broadcast(said) if size <= _BROADCAST_BYTES else said, "version").select(*DEP_KEY, "_ok", "_v")


def _listed_key() -> Column:
    return F.when(comparable(F.col("listed")), version_key(F.col("listed")))


def _hits_of_few(versions: DataFrame, told: DataFrame, answer: list[str]) -> DataFrame:
    """Each version with each rule of its package; for packages of few rules."""
    # the size of ``told`` is guessed from the advisories' files, which are far smaller than what is parsed from them
    both = versions.join(told.hint("merge"), ["ecosystem", "name"])
    inside = F.expr("_ok AND NOT unknown AND from_key <= _v AND (to_key IS NULL OR _v < to_key) AND (last_key IS NULL OR _v <= last_key)")
    status = F.when(F.col("listed").isNotNull(), F.when(F.expr("version = listed OR _v = listed_key"), "affected"))
    status = status.when(inside, "affected").when(F.expr("NOT _ok OR unknown"), "unknown")
    return both.withColumn("status", status).filter("status IS NOT NULL").select(*answer, "status")


def _hits_of_many(versions: DataFrame, told: DataFrame, shown: list[str], answer: list[str]) -> DataFrame:
    """The same by a sweep over versions and bounds and by equal texts and keys; for packages of many rules."""
    package = ["ecosystem", "name"]
    ranges, listed = told.filter("listed IS NULL"), told.filter("listed IS NOT NULL")
    known, asked = ranges.filter("NOT unknown"), ranges.filter("unknown")

    covered = _covered(versions.filter("_ok"), known)
    same = [covered[c].eqNullSafe(known[c]) for c in _BOUNDS]
    inside = covered.join(known, [covered[c] == known[c] for c in package] + same).select(*[covered[c] for c in package], "_v", *shown)
    affected = inside.join(versions.filter("_ok"), [*package, "_v"]).select(*answer)

    tokens = lambda text, key: F.explode(F.array_compact(F.array(F.concat(F.lit("t"), text), F.concat(F.lit("k"), key)))).alias("token")
    by_name = listed.select(*package, *shown, tokens(F.col("listed"), F.col("listed_key"))).join(versions.select(*DEP_KEY, tokens(F.col("version"), F.col("_v"))), [*package, "token"])
    affected = affected.unionByName(by_name.select(*answer)).withColumn("status", F.lit("affected"))

    unknown = versions.filter("NOT _ok").join(ranges, package).select(*answer).unionByName(versions.filter("_ok").join(asked, package).select(*answer))
    return affected.unionByName(unknown.withColumn("status", F.lit("unknown")))


def match(dependencies: DataFrame, told: DataFrame, few: int = _FEW_RULES) -> DataFrame:
    """(ecosystem, name, version, id, ..., status) for ``rules``; status is affected or unknown.

    Works on the distinct versions: a package a third of all projects use is
    one row per version here, whatever the number of projects.  In a package of at most ``few`` rules
    each version meets each rule, so a version makes at most that many rows.  In the others intervals are found by a
    sweep.  A listed version is hit by its text or, where both can be compared, by an equal version (1.2
    and v1.2.0).  Where the version or the range can't be compared, and nothing else
    says affected, the answer is unknown rather than nothing.
    """
    package = ["ecosystem", "name"]
    shown = [c for c in told.columns if c not in (*package, *_BOUNDS, "unknown", "listed")]
    answer = [*DEP_KEY, *shown]
    versions = _keyed(dependencies)
    told = cut_lineage(told.withColumn("listed_key", _listed_key()))
    many = cut_lineage(told.groupBy(*package).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select(*package))
    if many.isEmpty():
        hits = _hits_of_few(versions, told, answer)
    else:
        theirs = cut_lineage(versions.join(many, package, "left_semi"))
        hits = _hits_of_few(versions, told.join(many, package, "left_anti"), answer)
        hits = hits.unionByName(_hits_of_many(theirs, told.join(many, package, "left_semi"), shown, answer))
    return hits.groupBy(*answer).agg(F.min("status").alias("status"))


def audit(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every dependency row with every advisory that affects its version, or may do so."""
    hits = match(dependencies, rules(advisories, tuple(_display())))
    return dependencies.join(hits, DEP_KEY).withColumn("version_comparable", comparable(F.col("version")))


def hits_per_package(hits: DataFrame) -> DataFrame:
    """Distinct advisories of each package."""
    distinct = hits.select("ecosystem", "name", "id").distinct()
    return distinct.groupBy("ecosystem", "name").agg(
        F.count(F.lit(1)).alias("advisories"), F.array_sort(F.collect_list("id")).alias("ids")
    )
