"""Matching records: exact keys, validity intervals, editions. More than one match is never settled by taking the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.text import cosmetic_key, street_key
from terrafold.sources.sinks import fingerprint


def active(start: str, end: str, at: str) -> Column:
    """An open end is null; both ends are included."""
    return (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))


def as_of(records: DataFrame, versions: DataFrame, record: str, key: str, at: str) -> DataFrame:
    """For each record the version of its key that holds at its date: RESOLVED, AMBIGUOUS, NOT_ACTIVE (known key, no version then) or UNKNOWN_KEY."""
    met = records.select(record, key, at).join(versions, key, "left")
    holds = F.when(F.col("version").isNotNull() & active("valid_from", "valid_to", at), F.col("version"))
    found = met.groupBy(record).agg(F.count_distinct(holds).alias("versions"), F.min(holds).alias("one"), F.count("version").alias("known"))
    state = F.when(F.col("known") == 0, "UNKNOWN_KEY").when(F.col("versions") == 0, "NOT_ACTIVE").when(F.col("versions") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return found.select(record, "versions", state.alias("state"), F.when(state == "RESOLVED", F.col("one")).alias("version"))


def reconcile(left: DataFrame, right: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Each key of either side once: MATCHED, DIFFERS, LEFT_ONLY, RIGHT_ONLY or DUPLICATE."""
    side = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}_n"), *(F.min(c).alias(f"{p}_{c}") for c in compare))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    state = F.when((F.coalesce("l_n", F.lit(0)) > 1) | (F.coalesce("r_n", F.lit(0)) > 1), "DUPLICATE").when(F.col("r_n").isNull(), "LEFT_ONLY").when(F.col("l_n").isNull(), "RIGHT_ONLY").when(same, "MATCHED").otherwise("DIFFERS")
    return both.select(key, state.alias("state"))


def unique_pairs(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of two editions that correspond: the key is unique in its group on both sides, or the group has one row on each."""
    def side(df: DataFrame, p: str) -> DataFrame:
        by_key, by_group = Window.partitionBy(group, key), Window.partitionBy(group)
        return df.select(group, F.col(key).alias(f"{p}_key"), F.col("row_id").alias(f"{p}_row"), F.count("*").over(by_key).alias(f"{p}_same"), F.count("*").over(by_group).alias(f"{p}_all"))

    a, b = side(left, "a"), side(right, "b")
    alone = (F.col("a_all") == 1) & (F.col("b_all") == 1)
    keyed = (F.col("a_key") == F.col("b_key")) & (F.col("a_same") == 1) & (F.col("b_same") == 1)
    # the two conditions are joined apart, so that each stays an equi-join
    ones = a.where("a_all = 1").join(b.where("b_all = 1"), group).where(alone)
    rest = a.where("a_same = 1").withColumn("on", F.col("a_key")).join(b.where("b_same = 1").withColumn("on", F.col("b_key")), [group, "on"]).where(keyed & ~alone).drop("on")
    return ones.select(group, "a_row", "b_row", F.lit("ONLY_ROWS").alias("rule")).union(rest.select(group, "a_row", "b_row", F.lit("UNIQUE_KEY").alias("rule")))


def persistence(previous: DataFrame, current: DataFrame, key: str, attribute: str) -> DataFrame:
    """Transitions of an attribute between two snapshots; APPEARED and DISAPPEARED have one side."""
    a, b = previous.select(key, F.col(attribute).alias("was"), F.lit(True).alias("in_a")), current.select(key, F.col(attribute).alias("is"), F.lit(True).alias("in_b"))
    outcome = F.when(F.col("in_a").isNull(), "APPEARED").when(F.col("in_b").isNull(), "DISAPPEARED").when(F.col("was").eqNullSafe(F.col("is")), "SAME").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, "was", "is", outcome.alias("outcome"))


#: Every outcome that an edition comparison can have.
EDITION_OUTCOMES = ("NEW", "ABSENT", "STATE_TRANSITION", "QUANTITY_CHANGE", "NO_CHANGE", "NON_COMPARABLE")


def classify_editions(previous: DataFrame, current: DataFrame, key: str, phase: str, quantity: str) -> DataFrame:
    """One outcome for each code of either edition. A missing phase on a side that has the code is not comparable."""
    side = lambda df, p: df.select(key, F.col(phase).alias(f"{p}_phase"), F.col(quantity).alias(f"{p}_quantity"), F.lit(True).alias(f"{p}_has"))
    both = side(previous, "a").join(side(current, "b"), key, "full_outer")
    outcome = (
        F.when(F.col("a_has").isNull(), "NEW").when(F.col("b_has").isNull(), "ABSENT")
        .when(F.col("a_phase").isNull() | F.col("b_phase").isNull(), "NON_COMPARABLE")
        .when(F.col("a_phase") != F.col("b_phase"), "STATE_TRANSITION")
        .when(~F.col("a_quantity").eqNullSafe(F.col("b_quantity")), "QUANTITY_CHANGE").otherwise("NO_CHANGE")
    )
    return both.select(key, "a_phase", "b_phase", "a_quantity", "b_quantity", outcome.alias("outcome"))


def complete_edition(records: DataFrame, edition: str, key: str, canonical: DataFrame) -> DataFrame:
    """The newest edition that has each canonical key once and no other."""
    n = canonical.select(key).distinct().agg(F.count("*").alias("wanted"))
    known = records.join(canonical.select(key, F.lit(1).alias("known")), key, "left")
    per = known.groupBy(edition).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum("known").alias("known"))
    return per.join(F.broadcast(n)).where("rows = wanted and keys = wanted and known = wanted").agg(F.max(edition).alias(edition))


def resolved_inputs(requests: DataFrame, manifest: DataFrame, records: DataFrame, families: tuple[str, ...], key: str = "id", newest: str = "current") -> DataFrame:
    """(key, code, edition, state, inputs) of requests (key, code, wanted: map of family -> snapshot, or null).

    A request without a map takes the newest edition. Else every family, and no other, must be
    asked for by the snapshot that one and the same edition has; anything else resolves to
    nothing: NO_SUCH_EDITION, or UNKNOWN_CODE for a code that no edition has. A code that the
    edition itself lacks is ABSENT_FROM_EDITION, which is an answer. manifest: family, edition,
    snapshot; records: family, edition, code, value.
    """
    held = manifest.where(F.col("family").isin(*families)).groupBy("edition").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "snapshot")))).alias("held"))
    whole = held.where(F.size("held") == len(families)).select("edition", F.to_json("held").alias("selector"))
    ordered = F.map_from_entries(F.sort_array(F.map_entries("wanted")))
    asked = requests.select(key, "code", F.col("wanted").isNull().alias("open"), F.when(F.col("wanted").isNotNull(), F.to_json(ordered)).alias("selector"))
    matched = asked.join(whole, "selector", "left").select(key, "code", F.when(F.col("open"), newest).otherwise(F.col("edition")).alias("edition"))
    own = records.where(F.col("family").isin(*families)).groupBy("edition", "code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "value")))).alias("inputs"))
    known = records.select("code").distinct().withColumn("known", F.lit(True))
    found = matched.join(known, "code", "left").join(own, ["edition", "code"], "left")
    state = F.when(F.col("known").isNull(), "UNKNOWN_CODE").when(F.col("edition").isNull(), "NO_SUCH_EDITION").when(F.col("inputs").isNull(), "ABSENT_FROM_EDITION").otherwise("RESOLVED")
    return found.select(key, "code", "edition", state.alias("state"), F.when(state == "RESOLVED", F.col("inputs")).alias("inputs"))


def published_uses(codes: DataFrame, edition: DataFrame, uses: tuple[str, ...], key: str = "code", *keep: str) -> DataFrame:
    """(key, use, availability, square_m, keep) of each exact code and use: an edition without the code, a blank and a figure are three things, and rows are never added up.

    edition: key, a column for each use, and the columns to keep. The lookup is by the code
    alone, never by a place; a code of several rows gives each of them.
    """
    met = codes.select(key).join(edition.select(key, *uses, *keep, F.lit(True).alias("known")), key, "left")
    tall = met.select(key, "known", *keep, F.explode(F.array(*(F.struct(F.lit(u).alias("use"), F.col(u).alias("square_m")) for u in uses))).alias("u"))
    state = F.when(F.col("known").isNull(), "NOT_PUBLISHED_IN_EDITION").when(F.col("u.square_m").isNull(), "NOT_PUBLISHED").otherwise("PUBLISHED")
    return tall.select(key, "u.use", state.alias("availability"), "u.square_m", *keep)


def universes(**sides: DataFrame) -> DataFrame:
    """One row for each id, with a flag for each set: differences and intersections are filters on it."""
    marked = [df.select("id", *(F.lit(n == name).alias(n) for n in sides)) for name, df in sides.items()]
    out = marked[0]
    for m in marked[1:]:
        out = out.union(m)
    return out.groupBy("id").agg(*(F.max(n).alias(n) for n in sides))


def by_position(left: DataFrame, right: DataFrame, content: list[str]) -> DataFrame:
    """Row i of one table with row i of another (row_index), if both have the same rows under ``content``.

    The guard compares counts and order-free fingerprints of (row_index, content); where
    they differ, each row comes back unmatched with the state FINGERPRINT_DIFFERS.
    """
    sides = [fingerprint(df.select("row_index", *content)).select(F.col("fingerprint").alias(f"{p}_hash"), F.col("n").alias(f"{p}_n")) for p, df in (("a", left), ("b", right))]
    guard = sides[0].crossJoin(sides[1]).select((F.col("a_hash") == F.col("b_hash")).alias("same"))  # one row each
    rest = right.drop(*content)
    guarded = left.crossJoin(F.broadcast(guard))
    joined = guarded.join(rest.withColumnRenamed("row_index", "at"), F.col("same") & (F.col("row_index") == F.col("at")), "left")
    return joined.withColumn("state", F.when(~F.col("same"), "FINGERPRINT_DIFFERS").when(F.col("at").isNull(), "NO_ROW").otherwise("JOINED")).drop("same", "at")


def code_then_name(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source row by its code, else by district and folded name, else SOURCE_NULL or UNMATCHED; the method says which.

    source: id, era, code, district, name. target: era, code, district, name, of all
    eras; a row only meets the targets of its own era. A code whose district differs is a
    conflict, not a match. Several targets of one name in a district match by none.
    """
    known = target.select("era", "code", F.col("district").alias("t_district"), F.col("name").alias("t_name"))
    named = target.groupBy("era", "district", cosmetic_key(F.col("name")).alias("key")).agg(F.min("code").alias("n_code"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = source.join(known, ["era", "code"], "left").withColumn("key", cosmetic_key(F.col("name"))).join(named, ["era", "district", "key"], "left")
    by_code, agrees = F.col("t_name").isNotNull(), F.col("t_district") == F.col("district")
    blank = F.col("code").isNull() & (F.col("name").isNull() | F.col("key").contains("NULO"))
    method = F.when(by_code & agrees, "CODE").when(by_code, "CODE_DISTRICT_MISMATCH").when(F.col("n_code").isNotNull(), "DISTRICT_PLUS_NAME").when(blank, "SOURCE_NULL").otherwise("UNMATCHED")
    relation = F.when(F.col("name") == F.col("t_name"), "EXACT").when(F.col("key") == cosmetic_key(F.col("t_name")), "NORMALISED_EQUAL").when(by_code, "VARIANT").when(F.col("n_code").isNotNull(), "NORMALISED_EQUAL")
    found = F.when(method == "CODE", F.col("code")).when(method == "DISTRICT_PLUS_NAME", F.col("n_code"))
    return met.select("id", "era", method.alias("method"), F.when(found.isNotNull(), F.concat_ws(":", "era", found)).alias("entity"), F.when(method != "UNMATCHED", relation).alias("name_relation"))


def era_of(observed: DataFrame, snapshot: str, marks: dict[str, list[str]], otherwise: str) -> DataFrame:
    """(snapshot, era): the first era all of whose marking codes a snapshot has; decided from the codes seen, not from the calendar."""
    codes = observed.groupBy(snapshot).agg(*(F.count_distinct(F.when(F.col("code").isin(*own), F.col("code"))).alias(era) for era, own in marks.items()))
    era = F.lit(otherwise)
    for name, own in reversed(marks.items()):
        era = F.when(F.col(name) == len(own), name).otherwise(era)
    return codes.select(snapshot, era.alias("era"))


def match_gain(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(keys, exact, normalised): how many of the left keys the right side has as they are, and how many more it would have if folded. Nothing is joined by a folded key."""
    keys = left.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("f", cosmetic_key(F.col("k")))
    there = right.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("exact", F.lit(1))
    folded = right.select(cosmetic_key(F.col(key)).alias("f")).where("f is not null").distinct().withColumn("normal", F.lit(1))
    met = keys.join(there, "k", "left").join(folded, "f", "left")
    return met.agg(F.count("*").alias("keys"), F.count("exact").alias("exact"), F.count(F.when(F.col("exact").isNull(), F.col("normal"))).alias("gained"))


def routes_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each code of two routes to one geometry: whether names and the multisets of vertices agree.

    a, b: code, name, x, y, a row for each vertex. Vertices are counted, not listed.
    """
    side = lambda df, n: df.groupBy("code", "x", "y").agg(F.min("name").alias("name"), (F.count("*") * n).alias("n"), F.lit(n).alias("side"))
    both = side(a, 1).union(side(b, -1))
    points = both.groupBy("code", "x", "y").agg(F.sum("n").alias("n"), F.min(F.when(F.col("side") == 1, F.col("name"))).alias("a_name"), F.min(F.when(F.col("side") == -1, F.col("name"))).alias("b_name"), F.max("side").alias("high"), F.min("side").alias("low"))
    codes = points.groupBy("code").agg(F.min("a_name").alias("a_name"), F.min("b_name").alias("b_name"), F.sum(F.abs("n")).alias("vertices_apart"), F.max("high").alias("high"), F.min("low").alias("low"))
    state = F.when(F.col("low") > 0, "ONLY_A").when(F.col("high") < 0, "ONLY_B").when(~F.col("a_name").eqNullSafe(F.col("b_name")), "NAME_DIFFERS").when(F.col("vertices_apart") > 0, "VERTICES_DIFFER").otherwise("EQUIVALENT")
    return codes.select("code", "vertices_apart", state.alias("state"))


def by_street(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of two sides whose street names are equal once folded and without leading particles; no name is only near another."""
    key = street_key(F.col(name))
    a, b = left.withColumn("street", key).drop(name), right.withColumn("street", key).drop(name)
    return a.where("street <> ''").join(b, "street")
