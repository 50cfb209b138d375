"""Places named in words or codes to places of a register; register checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import all_issues, duplicate_keys


def level_of(code: Column) -> Column:
    """0 country, 1 canton, 2 municipality, by the parts of a code."""
    return F.size(F.split(code, "-")) - 1


def parent_of(code: Column) -> Column:
    return F.when(level_of(code) > 0, F.array_join(F.slice(F.split(code, "-"), F.lit(1), level_of(code)), "-"))


def label(code: Column, name: Column) -> Column:
    """A code with its level and, where known, its name."""
    word = F.when(level_of(code) == 1, "canton").otherwise("municipality")
    return F.when(level_of(code) == 0, F.concat(code, F.lit(" (federal)"))).otherwise(F.concat(code, F.lit(" ("), word, F.coalesce(F.concat(F.lit(" of "), name), F.lit("")), F.lit(")")))


def named_list(codes: Column, conjunction: str = "and") -> Column:
    """a, b and c."""
    n = F.size(codes)
    head = F.array_join(F.slice(codes, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(codes, F.lit(0))).otherwise(F.concat(head, F.lit(f" {conjunction} "), F.get(codes, n - 1)))


def _found(asked: DataFrame, register: DataFrame, level: int, value: str, within: str, fold: Callable[[Column], Column], out: str) -> DataFrame:
    """request_id and the codes of a level that fit a value below a place; a spelling that is equal as written wins.
    ``register`` may give names an ``order``: of the names that fit, those of the least order count (exact before loose)."""
    stage = F.col("order") if "order" in register.columns else F.lit(0)
    names = register.filter(level_of(F.col("code")) == level).select("code", "name", fold(F.col("name")).alias("key"), stage.alias("stage"))
    wanted = asked.filter(F.col(value).isNotNull()).select("request_id", F.col(value).alias("value"), F.col(within).alias("within"), fold(F.col(value)).alias("key"))
    hits = wanted.join(names, "key").filter(F.startswith("code", F.concat("within", F.lit("-"))) | (level == 0))
    first = hits.groupBy("request_id").agg(F.min("stage").alias("stage"))
    hits = hits.join(first, ["request_id", "stage"])
    exact = F.collect_set(F.when(F.trim("value") == F.col("name"), F.col("code")))
    return hits.groupBy("request_id").agg(exact.alias("e"), F.collect_set("code").alias("a")).select("request_id", F.array_sort(F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("a"))).alias(out))


def resolved(requests: DataFrame, register: DataFrame, default_country: str, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """request_id, served, country_code, canton_code, municipality, not_recognised (array), error.

    ``requests``: request_id, country, canton, city, names or codes, null or blank where not given. ``register``: code,
    name. A canton that fits nothing is not recognised, one that fits several is an error; a municipality must lie in
    the given canton, and its number counts only next to a canton or in a full code.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    asked = requests.select("request_id", *(blank(F.col(c)).alias(c) for c in ("country", "canton", "city"))).withColumn("none", F.lit(None).cast("string"))
    codes = register.select("code")
    # Country: none given, a code, or a name
    countries = codes.filter(level_of(F.col("code")) == 0).select(F.col("code").alias("by_code"))
    asked = asked.join(countries, F.upper("country") == F.col("by_code"), "left")
    asked = asked.join(_found(asked, register, 0, "country", "none", fold, "by_name"), "request_id", "left")
    country = F.when(F.col("country").isNull(), F.lit(default_country)).otherwise(F.coalesce("by_code", F.get("by_name", F.lit(0))))
    asked = asked.withColumn("country_code", country).withColumn("served", F.col("country_code").isNotNull()).drop("by_code", "by_name")
    # A country that is not served keeps its code, if a code was given
    stated = F.coalesce("country_code", F.when(F.col("country").rlike("^[A-Za-z][A-Za-z0-9]$"), F.upper("country")))
    asked = asked.withColumn("stated", stated)
    # Canton: the short code, with or without the country, or a name
    short = F.regexp_extract(F.upper("canton"), "^(?:([A-Z0-9]+)-)?([A-Z0-9]+)$", 2)
    own = F.regexp_extract(F.upper("canton"), "^(?:([A-Z0-9]+)-)?([A-Z0-9]+)$", 1)
    guess = F.when((short != "") & ((own == "") | (own == F.col("country_code"))), F.concat("country_code", F.lit("-"), short))
    cantons = codes.filter(level_of(F.col("code")) == 1).select(F.col("code").alias("canton_by_code"))
    asked = asked.withColumn("guess", guess).join(cantons, F.col("guess") == F.col("canton_by_code"), "left").drop("guess")
    asked = asked.join(_found(asked, register, 1, "canton", "country_code", fold, "cantons"), "request_id", "left")
    n = F.coalesce(F.size("cantons"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    asked = asked.withColumn("canton_code", F.coalesce("canton_by_code", F.when(n == 1, F.get("cantons", F.lit(0)))))
    asked = asked.withColumn("error", F.when(F.col("served") & F.col("canton_by_code").isNull() & (n > 1), "canton fits several"))
    lost = F.col("served") & F.col("canton").isNotNull() & F.col("canton_by_code").isNull() & (n == 0)
    asked = asked.withColumn("lost_canton", lost)
    # Municipality: a number in a code, a number next to a canton, or a name
    # whose country, if the code names one, is the one asked in; another country's code is taken for a name
    part = lambda k: F.regexp_extract(F.upper("city"), "^(?:(?:([A-Z0-9]+)-)?([A-Z][A-Z0-9]*)-)?([0-9]+)$", k)
    foreign = (part(1) != "") & (part(1) != F.col("country_code"))
    number, given = F.when(foreign, "").otherwise(part(3)), part(2)
    prefix = F.when(given != "", F.concat("country_code", F.lit("-"), given)).otherwise(F.col("canton_code"))
    asked = asked.withColumn("numbered", F.when(number != "", F.concat(prefix, F.lit("-"), F.ltrim(number, F.lit("0"))))).withColumn("is_number", F.coalesce(number != "", F.lit(False)))
    cities = codes.filter(level_of(F.col("code")) == 2).select(F.col("code").alias("city_by_code"))
    asked = asked.join(cities, F.col("numbered") == F.col("city_by_code"), "left")
    asked = asked.join(_found(asked, register, 2, "city", "country_code", fold, "by_name"), "request_id", "left")
    every = F.when(F.col("is_number"), F.array_compact(F.array("city_by_code"))).otherwise(F.coalesce("by_name", F.array().cast("array<string>")))
    asked = asked.withColumn("cities", every).withColumn("inside", F.filter("cities", lambda c: F.col("canton_code").isNull() | F.startswith(c, F.concat("canton_code", F.lit("-")))))
    wanted = F.col("served") & F.col("city").isNotNull()
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(wanted & (F.size("cities") > 0) & (F.size("inside") == 0), "city lies elsewhere").when(wanted & (F.size("inside") > 1), "city fits several")
    missing = F.array_compact(F.array(F.when(F.col("lost_canton"), "canton"), F.when(wanted & (F.size("cities") == 0), "city")))
    out = asked.withColumn("error", error).withColumn("municipality", F.when(F.col("served") & F.col("error").isNull() & (F.size("inside") == 1), F.get("inside", F.lit(0))))
    canton = F.when(F.col("served") & F.col("error").isNull(), F.coalesce("canton_code", parent_of(F.col("municipality"))))
    return out.select("request_id", "served", F.col("stated").alias("country_code"), canton.alias("canton_code"), "municipality", F.when(F.col("error").isNull(), missing).otherwise(F.array().cast("array<string>")).alias("not_recognised"), "error")


def register_issues(register: DataFrame) -> DataFrame:
    """rule, key, n: codes that repeat, that are malformed, or without their parent; blank names."""
    orphan = register.filter(parent_of(F.col("code")).isNotNull()).join(register.select(F.col("code").alias("p")), parent_of(F.col("code")) == F.col("p"), "left_anti")
    blank = register.filter(F.coalesce(F.trim("name"), F.lit("")) == "")
    one = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), F.col("code").alias("key"), F.lit(1).cast("bigint").alias("n"))
    malformed = register.filter(~F.coalesce(F.col("code").rlike("^[A-Z][A-Z0-9]+(-[A-Z][A-Z0-9]+(-[1-9][0-9]*)?)?$"), F.lit(False)))
    return all_issues(duplicate_keys(register, "place.code", "code"), one(malformed, "place.malformed"), one(orphan, "place.parent"), one(blank, "place.name"))


def applying_level(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, level, n_applying, n_narrower, elsewhere: the deepest published level that holds the place.

    ``facts``: topic, jurisdiction; ``requests``: request_id, topic, place. Narrower facts lie strictly below the
    place; elsewhere counts deeper places of the topic, all outside it, null when something lies below it. Facts count
    once per topic and jurisdiction; requests on topics without facts are left out.

    A place meets the places above it by equality on the few codes that lead to it, those below it by counts that each
    fact adds to the codes above its own, and the others by counts of its topic by level.
    """
    parts = lambda c: F.split(c, "-")
    upward = lambda c, least: F.transform(F.sequence(F.lit(1), F.size(parts(c)) - least), lambda k: F.array_join(F.slice(parts(c), F.lit(1), k), "-"))
    held = facts.select("topic", "jurisdiction").distinct()
    asked = requests.select("request_id", "topic", "place").join(held.select("topic").distinct(), "topic")
    over = asked.select("request_id", "topic", F.explode(upward(F.col("place"), 0)).alias("jurisdiction")).join(held, ["topic", "jurisdiction"])
    over = over.groupBy("request_id").agg(F.max(level_of(F.col("jurisdiction"))).alias("level"), F.count("*").alias("n_applying"))
    above = F.filter(upward(F.col("jurisdiction"), 0), lambda c: c != F.col("jurisdiction"))
    under = held.select("topic", F.explode(above).alias("place")).groupBy("topic", "place").agg(F.count("*").alias("n_narrower"))
    levels = held.groupBy("topic", level_of(F.col("jurisdiction")).alias("l")).agg(F.count("*").alias("n")).groupBy("topic").agg(F.collect_list(F.struct("l", "n")).alias("levels"))
    rows = asked.join(over, "request_id", "left").join(under, ["topic", "place"], "left").join(levels, "topic")
    deeper = F.aggregate("levels", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["l"] > F.coalesce("level", F.lit(-1)), x["n"]).otherwise(0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("request_id", "level", zero("n_applying"), zero("n_narrower"), F.when(F.col("n_narrower").isNull(), deeper).alias("elsewhere"))
