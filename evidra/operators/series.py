"""Time-series gates, catalogue expansion and cross checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.urls import host

#: The order in which a row's checks apply.
CODES = ("COUNTRY_MISMATCH", "INDICATOR_MISMATCH", "INVALID_YEAR", "OUT_OF_SCOPE_YEAR", "DUPLICATE_YEAR", "INVALID_VALUE", "MISSING_YEARS")


def check_series(rows: DataFrame, start: int, end: int, topic: str | None = None) -> DataFrame:
    """Every violation of each series, ``series_id, code, locator, observed, position``.

    ``rows(series_id, position, country, iso3, indicator, expected_country,
    expected_iso3, expected_indicator, date, value)``, ``date`` a string and
    ``value`` a double.  A row gives its first failing check.  ``DUPLICATE``
    looks at earlier rows of a valid year.  ``MISSING_YEARS`` is given for a
    series whose rows have no violation, and lists the years.
    """
    year = F.col("date").try_cast("int")
    valued = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    bad_value = ~valued
    if topic == "population":
        bad_value = bad_value | (F.col("value") < 0) | (F.col("value") != F.floor("value"))
    if topic == "life expectancy":
        bad_value = bad_value | ~((F.col("value") > 0) & (F.col("value") < 130))
    w = Window.partitionBy("series_id", "year").orderBy("position")
    numbered = rows.withColumn("year", year).withColumn("again", F.row_number().over(w) > 1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    path = F.concat(F.lit("$[1]["), F.col("position").cast("string"), F.lit("]"))
    checks = [
        (~same("country", "expected_country") | ~same("iso3", "expected_iso3"), CODES[0], ".country", F.concat_ws("/", "country", "iso3")),
        (~same("indicator", "expected_indicator"), CODES[1], ".indicator.id", F.col("indicator")),
        (F.col("year").isNull(), CODES[2], ".date", F.col("date")),
        (~F.col("year").between(start, end), CODES[3], ".date", F.col("date")),
        (F.col("again"), CODES[4], ".date", F.col("date")),
        (bad_value, CODES[5], ".value", F.col("value").cast("string")),
    ]
    first = F.coalesce(*[F.when(c, F.struct(F.lit(code).alias("code"), F.concat(path, F.lit(part)).alias("locator"), seen.alias("observed"))) for c, code, part, seen in checks])
    judged = numbered.withColumn("v", first)
    wrong = judged.where(F.col("v").isNotNull()).select("series_id", "v.code", "v.locator", "v.observed", "position")
    good = judged.groupBy("series_id").agg(F.count_if(F.col("v").isNotNull()).alias("n"), F.collect_set(F.when(F.col("v").isNull(), F.col("year"))).alias("have"))
    missing = F.array_except(F.sequence(F.lit(start), F.lit(end)), F.col("have"))
    gaps = good.where((F.col("n") == 0) & (F.size(missing) > 0))
    return wrong.unionByName(gaps.select("series_id", F.lit(CODES[6]).alias("code"), F.lit("$[1]").alias("locator"), F.array_join(F.array_sort(missing), ",").alias("observed"), F.lit(None).cast(rows.schema["position"].dataType).alias("position")))


#: The order in which the strict gate's checks apply.
STRICT = ("WRONG_SOURCE", "NO_UPDATE_DATE", "WRONG_COUNTRY", "WRONG_INDICATOR", "INVALID_YEAR", "YEAR_OUT_OF_SCOPE_OR_REPEATED", "INVALID_VALUE", "NOT_INTEGER", "MISSING_YEARS")


def pilot_gate(rows: DataFrame, start: int, end: int, source: str = "2", integers: bool = True) -> DataFrame:
    """The first failure of each series, ``series_id, code, position``; a series without one isn't returned.

    ``rows`` as for :func:`check_series`, with ``sourceid, lastupdated`` of
    the payload.  The payload is checked first, then row by row in order, a
    repeated year against the rows before it, then the set of years.
    """
    year = F.col("date").try_cast("int")
    before = Window.partitionBy("series_id", "year").orderBy("position")
    r = rows.withColumn("year", year).withColumn("again", F.row_number().over(before) > 1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    value = F.col("value")
    row_checks = [
        (~same("country", "expected_country") | ~same("iso3", "expected_iso3"), STRICT[2]),
        (~same("indicator", "expected_indicator"), STRICT[3]),
        (F.col("year").isNull(), STRICT[4]),
        (~F.col("year").between(start, end) | F.col("again"), STRICT[5]),
        (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0), STRICT[6]),
        (F.lit(integers) & (value != F.floor(value)), STRICT[7]),
    ]
    code = F.coalesce(*[F.when(c, F.lit(name)) for c, name in row_checks])
    judged = r.withColumn("code", code)
    bad = F.struct("position", "code")
    one = judged.groupBy("series_id").agg(
        F.bool_and(F.coalesce(F.col("sourceid") == source, F.lit(False))).alias("source_ok"),
        F.bool_and(F.coalesce(F.col("lastupdated"), F.lit("")) != "").alias("dated"),
        F.min(F.when(F.col("code").isNotNull(), bad)).alias("bad"),
        F.count_distinct("year").alias("years"),
    )
    found = F.when(~F.col("source_ok"), STRICT[0]).when(~F.col("dated"), STRICT[1]).when(F.col("bad").isNotNull(), F.col("bad.code")).when(F.col("years") < end - start + 1, STRICT[8])
    at = F.when(F.col("source_ok") & F.col("dated"), F.col("bad.position"))
    return one.select("series_id", found.alias("code"), at.alias("position")).where(F.col("code").isNotNull())


def enriched(observations: DataFrame, source: DataFrame) -> DataFrame:
    """Observations with where they come from: ``source(series_id, source_url, raw_path, raw_sha256, dataset_version)``."""
    return observations.join(source.select("series_id", "source_url", "raw_path", "raw_sha256", "dataset_version"), "series_id", "left")


#: Hosts of the publisher's catalogue pages, and the metric that a topic names there.
CATALOGUE_HOSTS = ("data.worldbank.org", "datacatalog.worldbank.org", "databank.worldbank.org")
TOPIC_METRICS = {"population": "population, total", "life expectancy": "life expectancy at birth, total (years)"}


def origins(candidates: DataFrame) -> DataFrame:
    """Candidates on one of the publisher's catalogue hosts."""
    return candidates.where(host(F.col("url")).isin(*CATALOGUE_HOSTS))


def expand_catalog(candidates: DataFrame, catalogue: DataFrame, topic: str | None, country: str | None) -> DataFrame:
    """``candidates(url, title, search_queries, relevance, priority, catalog_verified)`` and one verified page of the catalogue.

    It is added, or takes the place of a candidate of its URL, if a candidate
    is on a catalogue host, the topic names a metric, and the complete
    catalogue ``(id, name, source_id, source_note, source_organization)`` has exactly one of that name
    with a valid identifier; otherwise the candidates come back as they are.
    """
    if topic not in TOPIC_METRICS or not country:
        return candidates
    from evidra.functions.text import fold

    named = catalogue.withColumn("name_folded", fold(F.col("name"))).where((F.col("name_folded") == TOPIC_METRICS[topic]) & (F.col("source_id") == "2"))
    # At most one row: the count decides, and the queries come from the origins.
    only = named.agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("name").alias("title")).where((F.col("n") == 1) & F.col("id").rlike("^[A-Za-z0-9_.]+$"))
    asked = origins(candidates).select(F.explode("search_queries").alias("q")).agg(F.array_sort(F.collect_set("q")).alias("search_queries"), F.count("*").alias("m")).where("m > 0").drop("m")
    url = F.concat(F.lit("https://data.worldbank.org/indicator/"), "id", F.lit(f"?locations={country}"))
    made = only.crossJoin(F.broadcast(asked)).select(url.alias("url"), "title", "search_queries", F.lit(20).alias("relevance"), F.lit(4).alias("priority"), F.lit(True).alias("catalog_verified"))
    others = candidates.join(F.broadcast(made.select("url")), "url", "left_anti")
    return others.unionByName(made, allowMissingColumns=True)


def import_series(rows: DataFrame, twin: DataFrame, source: DataFrame, start: int, end: int, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified observations of JSON rows and their XML twin, and the failures by series.

    Both formats pass the gate (D2), agree with each other (J1), and the gate
    refuses a row with a false country (D7); what is left is projected (P1)
    and told its source (P2).
    """
    year = lambda d: d.select("series_id", F.col("date").try_cast("int").alias("year"), "value")
    wrong = check_series(rows, start, end, topic).select("series_id", "code").unionByName(check_series(twin, start, end, topic).select("series_id", "code"))
    differ = cross_check(year(rows), year(twin), ["series_id", "year"], "value").select("series_id", F.lit("CROSSCHECK_MISMATCH").alias("code"))
    lax = negative_control(rows, start, end, topic).where(~F.col("rejected")).select("series_id", F.lit("CONTROL_PASSED").alias("code"))
    failures = wrong.unionByName(differ).unionByName(lax).distinct()
    return enriched(accepted(rows, failures), source), failures


def first_errors(violations: DataFrame) -> DataFrame:
    """The first violation of each series by position, as a gate that stops there reports it."""
    best = F.min_by(F.struct("code", "locator", "observed"), F.coalesce("position", F.lit(1 << 30)))
    return violations.groupBy("series_id").agg(best.alias("v")).select("series_id", "v.*")


def accepted(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Observations of the series without violations, with their original locator, by year."""
    ok = rows.join(violations.select("series_id").distinct(), "series_id", "left_anti")
    locator = F.concat(F.lit("$[1]["), F.col("position").cast("string"), F.lit("]"))
    return ok.select("series_id", F.col("date").cast("int").alias("year"), "value", locator.alias("raw_locator"))


def missing_years(rows: DataFrame, start: int, end: int) -> DataFrame:
    """``series_id, missing``: years of the range without a row; they stay missing."""
    have = rows.groupBy("series_id").agg(F.collect_set("year").alias("have"))
    return have.select("series_id", F.array_sort(F.array_except(F.sequence(F.lit(start), F.lit(end)), "have")).alias("missing"))


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that one table lacks or where values differ, null-safe, by a full outer join."""
    left = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    right = b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    both = left.join(right, keys, "full_outer")
    kind = F.when(F.col("in_right").isNull(), "only_left").when(F.col("in_left").isNull(), "only_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "differs")
    return both.withColumn("mismatch", kind).where(F.col("mismatch").isNotNull()).select(*keys, "left_value", "right_value", "mismatch")


def delta(rows: DataFrame, start: int, end: int) -> DataFrame:
    """``series_id, delta``: the value of the last year less that of the first."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    return rows.groupBy("series_id").agg((at(end) - at(start)).alias("delta"))


def single_source(rows: DataFrame) -> DataFrame:
    """``series_id, n_sources, accepted``: a series from more than one raw file is refused."""
    return rows.groupBy("series_id").agg(F.count_distinct(F.struct("raw_path", "raw_sha256")).alias("n_sources")).withColumn("accepted", F.col("n_sources") == 1)


def unique_metric(catalogue: DataFrame, name: str, source: str) -> DataFrame:
    """the metric of that exact name and source, with a note and an organisation; no row unless it is the only one."""
    found = catalogue.where((F.lower("name") == name.lower()) & (F.col("source_id") == source))
    n = found.agg(F.count("*").alias("matches"))
    ok = (F.coalesce(F.trim("source_note"), F.lit("")) != "") & (F.coalesce(F.trim("source_organization"), F.lit("")) != "")
    return found.crossJoin(F.broadcast(n)).where((F.col("matches") == 1) & ok).drop("matches")


def negative_control(rows: DataFrame, start: int, end: int, topic: str | None = None) -> DataFrame:
    """``rejected``: whether the gate rejects every series once one row's country is replaced."""
    first = rows.groupBy("series_id").agg(F.min("position").alias("p"))
    broken = rows.join(first, "series_id").withColumn("country", F.when(F.col("position") == F.col("p"), F.lit("ZZ")).otherwise(F.col("country"))).drop("p")
    found = check_series(broken, start, end, topic).where(F.col("code") == "COUNTRY_MISMATCH").select("series_id").distinct().withColumn("hit", F.lit(True))
    return rows.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.coalesce("hit", F.lit(False)).alias("rejected"))
