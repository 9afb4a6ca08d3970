"""Client records: dimension checks, display names and identity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from ..session import shared_dir


# --- enum dimension -------------------------------------------------------------------------------------
def visible_enums(enums: DataFrame, enum_type: str | None = None, tenant: str | None = None) -> DataFrame:
    """Active entries: global ones, plus the tenant's own when a tenant is given."""
    scope = F.col("tenant_id").isNull() if not tenant else F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant)
    d = enums.where(F.col("is_active") & scope)
    return d if enum_type is None else d.where(F.col("enum_type") == enum_type)


def grouped_enums(enums: DataFrame) -> DataFrame:
    """Entries per type in sort order. The dimension is small by nature, one array per type."""
    return enums.groupBy("enum_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "code", "label"))), lambda x: x["code"]).alias("codes"))


def enum_duplicates(enums: DataFrame) -> DataFrame:
    return enums.groupBy("enum_type", "code", "label", "sort_order", "is_active").agg(F.count("*").alias("n")).where("n > 1")


def enum_violations(clients: DataFrame, enums: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(id, enum_type, code) of client values missing from the active dimension, any tenant."""
    fields = [f for f in (fields or V.CLIENT_ENUM_FIELDS) if f in clients.columns]
    pairs = ", ".join(f"'{f}', cast({f} as string)" for f in fields)
    long = clients.selectExpr("id", f"stack({len(fields)}, {pairs}) as (enum_type, code)").where("code <> ''")
    return long.join(enums.where("is_active").select("enum_type", "code").distinct(), ["enum_type", "code"], "left_anti")


# --- records --------------------------------------------------------------------------------------------------
def violations(strict_blank: bool = True) -> Column:
    """Names of the checks a client record fails. ``strict_blank`` also rejects names of blanks only."""

    def missing(c: str) -> Column:
        v = S.strip(F.col(c)) if strict_blank else F.col(c)
        return F.coalesce(v, F.lit("")) == ""

    et = F.upper(F.coalesce("entity_type", F.lit("")))
    email_ok = F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    phone_ok = F.col("phone").rlike(r"^[+0-9\s\-().]{6,20}$")
    return F.array_compact(F.array(
        F.when(et == "", F.lit("entity_type")),
        F.when((et == "INDIVIDUAL") & missing("first_name"), F.lit("first_name")),
        F.when((et == "INDIVIDUAL") & missing("last_name"), F.lit("last_name")),
        F.when((et == "BUSINESS") & missing("business_name"), F.lit("business_name")),
        F.when((et == "TRUST") & missing("trust_name"), F.lit("trust_name")),
        F.when((F.col("email") != "") & ~email_ok, F.lit("email")),
        F.when((F.col("phone") != "") & ~phone_ok, F.lit("phone")),
    ))


def tag_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), S.strip), lambda t: t != "")


def full_name() -> Column:
    return S.strip(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))


def display_name(default: str = "Unknown Client") -> Column:
    """Business, else trust, else person name."""

    def clean(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(clean(F.col("business_name")), clean(F.col("trust_name")),
                      clean(F.concat_ws(" ", "first_name", "last_name")), F.lit(default))


def card_name(default: str = "Unnamed") -> Column:
    """Person name first for individuals, organisation names first otherwise."""
    person = F.nullif(full_name(), F.lit(""))
    organisation = F.coalesce(F.nullif(F.col("business_name"), F.lit("")), F.nullif(F.col("trust_name"), F.lit("")))
    return F.when(F.upper("entity_type") == "INDIVIDUAL", F.coalesce(person, F.lit(default))).otherwise(
        F.coalesce(organisation, person, F.lit(default)))


def page_of_clients(clients: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest clients first; limit 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset not negative")
    return clients.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


# --- identity ---------------------------------------------------------------------------------------------------
def identity_keys(clients: DataFrame) -> DataFrame:
    """(id, key) for every key a client can be recognised by: digits of the tax id, and names."""
    digits = S.digits_only(F.col("tax_id"))
    person = F.when(F.upper("entity_type") == "INDIVIDUAL", F.nullif(S.norm_name(full_name()), F.lit("")))
    names = [S.norm_name(F.col("business_name")), S.norm_name(F.col("trust_name")), person, S.norm_name(card_name())]
    keys = F.array_distinct(F.array_compact(F.array(
        F.when(F.length(digits) >= 4, F.concat(F.lit("t:"), digits)),
        *[F.when(n != "", F.concat(F.lit("n:"), n)) for n in names])))
    return clients.select("id", F.explode(keys).alias("key"))


def match_identities(identities: DataFrame, clients: DataFrame) -> DataFrame:
    """First client (smallest id) for each extracted identity (ident_id, name, tin).

    The OR of identifier and name equality becomes one equi join on exploded keys. Client keys are reduced
    to their smallest id first, so a key shared by many clients costs one row, not a product.
    """
    keys = identity_keys(clients).groupBy("key").agg(F.min("id").alias("client_id"))
    digits = S.digits_only(F.col("tin"))
    mine = identities.select("ident_id", F.explode(F.array_compact(F.array(
        F.when(F.length(digits) >= 4, F.concat(F.lit("t:"), digits)),
        F.when(S.norm_name(F.col("name")) != "", F.concat(F.lit("n:"), S.norm_name(F.col("name"))))))).alias("key"))
    return mine.join(keys, "key").groupBy("ident_id").agg(F.min("client_id").alias("client_id"))


def match_exact(identities: DataFrame, clients: DataFrame) -> DataFrame:
    """First client by case-insensitive full name or by equal tax id, smallest id first."""
    person = F.when(F.col("entity_type") == "INDIVIDUAL", full_name()).otherwise(
        F.coalesce(F.nullif("business_name", F.lit("")), F.nullif("trust_name", F.lit("")), F.lit("")))
    keys = clients.select("id", F.explode(F.array_compact(F.array(
        F.when(person != "", F.concat(F.lit("n:"), F.lower(person))), F.concat(F.lit("t:"), F.col("tax_id"))))).alias("key"))
    keys = keys.groupBy("key").agg(F.min("id").alias("client_id"))
    mine = identities.select("ident_id", F.explode(F.array_compact(F.array(
        F.when(F.col("name") != "", F.concat(F.lit("n:"), F.lower("name"))),
        F.when(F.col("tin") != "", F.concat(F.lit("t:"), F.col("tin")))))).alias("key"))
    return mine.join(keys, "key").groupBy("ident_id").agg(F.min("client_id").alias("client_id"))


def lifecycle_by_name(clients: DataFrame) -> DataFrame:
    """(key, lifecycle_stage): the last client per normalised name wins; trust over business over person."""
    person = F.when((F.col("first_name") != "") & (F.col("last_name") != ""), F.concat_ws(" ", "first_name", "last_name"))
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), S.norm_name(c).alias("key"))
                     for i, c in enumerate([person, F.col("business_name"), F.col("trust_name")])])
    long = clients.select("id", "created_at", "lifecycle_stage", F.explode(keys).alias("k")).where("k.key <> ''")
    return long.groupBy(F.col("k.key").alias("key")).agg(
        F.max_by("lifecycle_stage", F.struct(F.col("created_at"), F.col("id"), F.col("k.rank"))).alias("lifecycle_stage"))


# --- containment ------------------------------------------------------------------------------------------------
LONGEST = 32


def _pieces(c: Column, n: int) -> Column:
    """Distinct substrings of length n."""
    last = F.length(c) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(c, i + 1, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def contained_names(names: DataFrame, clients: DataFrame, longest: int = LONGEST) -> DataFrame:
    """First client whose name contains each given name: (name_key, client_id).

    Exact and without a pairwise join: client names are cut into their substrings of the lengths that the given names
    have, and a name is joined with the substring that equals it. So the rows are in proportion to the client text, however similar the
    names are. Substrings longer than ``longest`` travel as their length and hash, and what meets is compared in full. Both sides are
    sorted and merged: Spark takes substrings for as few as the client names they are cut from, and would broadcast millions of them. Tiers are
    person, business, trust name; within a tier the oldest client wins.
    """
    person = F.lower(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    tiers = F.array(*[F.struct(F.lit(i).alias("tier"), c.alias("full"))
                      for i, c in enumerate([person, F.lower("business_name"), F.lower("trust_name")])])
    full = clients.select("id", "created_at", F.explode(tiers).alias("t")).select("id", "created_at", "t.*").where("full <> ''")
    # equal full names in a tier differ only in who wins, so one row per name is enough
    full = full.groupBy("tier", "full").agg(F.min(F.struct("created_at", "id")).alias("who"))
    wanted = names.select(S.strip(F.lower("name_key")).alias("key")).where("key <> ''").distinct().withColumn("size", F.length("key"))
    lengths = sorted(r[0] for r in wanted.select("size").distinct().collect())  # as many as names have lengths
    short, long = [n for n in lengths if n <= longest], [n for n in lengths if n > longest]
    best = F.struct("tier", "who").alias("best")
    cut = full.select(best, F.explode(F.concat(F.array().cast("array<string>"), *[_pieces(F.col("full"), n) for n in short])).alias("piece"))
    hits = [wanted.where(F.col("size") <= longest).join(cut.hint("merge"), F.col("key") == F.col("piece")).select("key", "best")]
    if long:
        named = F.flatten(F.transform(F.array(*[F.lit(n) for n in long]), lambda n: F.when(F.length("full") >= n, F.transform(
            F.sequence(F.lit(0), F.length("full") - n), lambda i: F.struct(n.alias("size"), F.xxhash64(F.substr("full", i + 1, n)).alias("h")))).otherwise(F.array().cast("array<struct<size:int,h:bigint>>"))))
        cut = full.select("full", best, F.explode(F.array_distinct(named)).alias("p")).select("full", "best", "p.*")
        met = wanted.where(F.col("size") > longest).withColumn("h", F.xxhash64("key")).join(cut.hint("merge"), ["size", "h"])
        hits.append(met.where(F.col("full").contains(F.col("key"))).select("key", "best"))
    every = hits[0] if len(hits) == 1 else hits[0].union(hits[1])
    found = every.groupBy("key").agg(F.min("best").alias("best"))
    return found.select(F.col("key").alias("name_key"), F.col("best.who.id").alias("client_id"), F.col("best.tier").alias("tier"))


def sync_client_ids(ledger: DataFrame, logs: DataFrame, clients: DataFrame, only_missing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger and logs with matched client ids, and the counters of what changed."""
    keyed = ledger.withColumn("name_key", S.strip(F.lower("client_name")))
    m = contained_names(keyed.select("name_key"), clients).select("name_key", F.col("client_id").alias("found"))
    j = keyed.join(m, "name_key", "left")
    allowed = F.col("client_id").isNull() if only_missing else F.lit(True)
    new_ledger = j.withColumn("changed", F.col("found").isNotNull() & allowed & ~F.col("client_id").eqNullSafe(F.col("found")))
    if only_missing:
        lg = logs.withColumn("name_key", S.strip(F.lower("client_name"))).join(m, "name_key", "left")
    else:
        lg = logs.join(j.select("document_id", "found"), "document_id", "left")
    lg_allowed = F.col("client_id").isNull() if only_missing else F.lit(True)
    new_logs = lg.withColumn("changed", F.col("found").isNotNull() & lg_allowed & ~F.col("client_id").eqNullSafe(F.col("found")))
    # one aggregate over both tables instead of joining two totals
    marks = new_ledger.select(F.lit(True).alias("is_ledger"), F.col("found").isNotNull().alias("hit"), "changed").unionByName(
        new_logs.select(F.lit(False).alias("is_ledger"), F.lit(False).alias("hit"), "changed"))
    on = F.col("is_ledger")
    counts = marks.agg(
        F.count_if(on).alias("total_ledger_rows"), F.count_if(on & F.col("hit")).alias("matched_clients"),
        F.count_if(on & F.col("changed")).alias("updated_ledger_rows"),
        F.count_if(~on & F.col("changed")).alias("updated_document_log_rows"))
    put = lambda d: d.withColumn("client_id", F.when(F.col("changed"), F.col("found")).otherwise(F.col("client_id"))).drop("found", "changed", "name_key")
    return put(new_ledger), put(new_logs), counts


# --- merged clients ---------------------------------------------------------------------------------------------
def surviving_clients(merges: DataFrame) -> DataFrame:
    """(client_id, survivor, cyclic) for every client that was merged into another (``client_id``, ``merged_into`` [, ``merged_at``]).

    A client's last merge counts. Chains are followed by pointer doubling: each round joins the open clients with the targets of their targets, so
    a chain of n merges takes log n joins, and only clients that have not met a survivor go on. A client whose chain never ends has no survivor
    and is marked as cyclic. Merges into oneself or into nothing are none.
    """
    spark = merges.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = shared_dir(spark, "merges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    at = F.col("merged_at") if "merged_at" in merges.columns else F.lit(0)
    valid = merges.where("client_id IS NOT NULL AND merged_into IS NOT NULL AND client_id <> merged_into")
    arrows = stored(valid.groupBy("client_id").agg(F.max_by("merged_into", F.struct(at, "merged_into")).alias("merged_into")))
    steps, count, open_, done = arrows, arrows.count(), arrows.select("client_id", F.col("merged_into").alias("to")), []
    reach = 1
    while True:
        ahead = stored(open_.join(steps.select(F.col("client_id").alias("to"), F.col("merged_into").alias("next")), "to", "left"))
        done.append(ahead.where("next IS NULL").select("client_id", F.col("to").alias("survivor"), F.lit(False).alias("cyclic")))
        open_ = ahead.where("next IS NOT NULL").select("client_id", F.col("next").alias("to"))
        # an end has no arrow; one that was reached by a doubled arrow is an end again
        if open_.isEmpty() or reach > 2 * count:
            break
        second = steps.select(F.col("client_id").alias("merged_into"), F.col("merged_into").alias("far"))
        steps = stored(steps.join(second, "merged_into", "left").select("client_id", F.coalesce("far", "merged_into").alias("merged_into")))
        reach *= 2
    out = open_.select("client_id", F.lit(None).cast(dict(arrows.dtypes)["merged_into"]).alias("survivor"), F.lit(True).alias("cyclic"))
    for d in done:
        out = out.unionByName(d)
    return out
