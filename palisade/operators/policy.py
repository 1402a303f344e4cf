"""Policy audits and the operators that are specified as extensions: rules, scope, privacy, pruning, onboarding."""

from __future__ import annotations

from bisect import bisect_right
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.plans.ordered import carried


def cipher_policy(negotiations: DataFrame, floor: str = "null") -> DataFrame:
    """The cipher each session may use and whether its bond's or the server's minimum was missed."""
    best = S.cipher_choice(F.col("offered"), F.col("bond_type"), F.col("has_key"), floor)
    free = S.cipher_choice(F.col("offered"), F.lit(None).cast("string"), F.col("has_key"))
    return negotiations.withColumns({"cipher": best, "rejected": best != free})


def role_violations(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """Calls whose class is outside their entity's role. roles: (entity, class)."""
    return calls.join(roles.select("entity", "class").distinct(), ["entity", "class"], "left_anti")


def apply_grace(threats: DataFrame, members: DataFrame) -> DataFrame:
    """Threats without those of members in their grace time. members: (source, joined_at, grace_until); times of a member
    may overlap. The latest grace_until of what a source has joined so far is carried along its threats."""
    kind = threats.schema["detected_at"].dataType
    m = members.select(F.lit(None).alias("_row"), F.col("source").alias("_s"), F.col("joined_at").cast(kind).alias("_t"), F.lit(0).alias("_nth"), F.col("grace_until").cast(kind).alias("_until"))
    t = threats.select(F.struct(*threats.columns).alias("_row"), F.col("source").alias("_s"), F.col("detected_at").alias("_t"), F.lit(1).alias("_nth"), F.lit(None).alias("_until"))
    m = m.where("_s is not null and _t is not null")
    c = carried(m.unionByName(t), ["_s"], ["_t", "_nth"], F.col("_until"), "_grace", how="max")
    return c.where(F.col("_row").isNotNull() & ~F.coalesce(F.col("_t") < F.col("_grace"), F.lit(False))).select("_row.*")


# --- rules: (rule_id, field, lo, hi); a rule fires where lo <= value < hi ----------------------

def _place(c: Column) -> Column:
    """A value's place in the order of cells: NaN stands above all numbers, as in comparisons, and zero has one sign."""
    return F.when(F.isnan(c), float("inf")).when(c == 0, 0.0).otherwise(c)


def _cut(df: DataFrame, columns: dict[str, str], splits: list[float]) -> DataFrame:
    """df plus the cell of each column (from: to); a null has none."""
    spread = df.withColumns({f"{to}_at": _place(F.col(c)) for c, to in columns.items()})
    ends = [float("-inf"), *splits, float("inf")]
    found = Bucketizer(splitsArray=[ends] * len(columns), inputCols=[f"{to}_at" for to in columns.values()], outputCols=list(columns.values()), handleInvalid="keep").transform(spread)
    return found.withColumns({to: F.when(F.col(c).isNotNull(), F.col(to).cast("int")) for c, to in columns.items()}).drop(*[f"{to}_at" for to in columns.values()])


def value_cells(values: DataFrame, fields: list[str], cells: int) -> list[tuple[list[float], list[int]]]:
    """(splitters, ways) of each field: cells of about equally many values, and into how many ways each is divided. A value
    that fills several quantiles is one cell of as many ways, so no (cell, way) holds much more than 1/cells of the rows.
    At most `cells` numbers of a field come to the driver."""
    placed = values.select([_place(F.col(f)).alias(f"_v{i}") for i, f in enumerate(fields)])
    quantiles = placed.approxQuantile(placed.columns, [i / cells for i in range(1, cells)], 1 / (2 * cells))
    out = []
    for q in quantiles:
        splits = sorted({v for v in q if isfinite(v)}) or [0.0]
        ways = [0] * (len(splits) + 1)
        for v in q:
            ways[bisect_right(splits, v)] += 1
        out.append((splits, [max(w, 1) for w in ways]))
    return out


def fired(rows: DataFrame, rules: DataFrame, key: list[str], fields: list[str], cells: int | None = None) -> DataFrame:
    """(key, rule_id) of rows and rules that fire on them, each once. A null bound is open, a null value fires nothing, NaN
    counts as above all numbers.

    An interval index: each field's values are cut into cells of equal weight (`cells`, four for each shuffle partition), a
    rule is entered in every cell that it touches, and rows are joined on their cell and a way within it. Inside a rule's
    first and last cell an entry stands for as many hits as the cell has rows, so there are never many more entries
    than hits, however wide rules are. `key` tells rows apart: ways are dealt by its hash."""
    cells = cells or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(*key, *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)])
    wanted = rules.select("rule_id", "field", F.col("lo").cast("double").alias("_lo"), F.col("hi").cast("double").alias("_hi")).where("_lo is null or _hi is null or _lo < _hi")
    found, entered = [], None
    for i, (splits, ways) in enumerate(value_cells(values, [f"_v{i}" for i in range(len(fields))], cells)):
        values = _cut(values, {f"_v{i}": f"_c{i}"}, splits)
        n_ways = F.get(F.lit(ways), F.col(f"_c{i}"))
        found.append(F.struct(F.lit(i).alias("_f"), F.col(f"_v{i}").alias("_v"), F.col(f"_c{i}").alias("_c"), F.pmod(F.xxhash64(*key), n_ways).cast("int").alias("_w")))
        r = _cut(wanted.where(F.col("field") == fields[i]), {"_lo": "_from", "_hi": "_to"}, splits)
        r = r.withColumn("_c", F.explode(F.sequence(F.coalesce("_from", F.lit(0)), F.coalesce("_to", F.lit(len(splits))))))
        r = r.withColumn("_w", F.explode(F.sequence(F.lit(0), F.get(F.lit(ways), F.col("_c")) - 1))).select(F.lit(i).alias("_f"), "_c", "_w", "_lo", "_hi", "rule_id")
        entered = r if entered is None else entered.unionByName(r)
    long = values.select(*key, F.inline(F.array(*found))).where("_v is not null")
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    return long.join(entered, ["_f", "_c", "_w"]).where(inside).select(*key, "rule_id").distinct()


def select_detectors(rules: DataFrame, own: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Negative selection: rules that fire on no row of the own side."""
    return rules.join(fired(own, rules, key, fields).select("rule_id").distinct(), "rule_id", "left_anti")


def patrol(rows: DataFrame, rules: DataFrame, key: list[str], fields: list[str], quorum: int = 2) -> DataFrame:
    """Rows on which at least `quorum` rules fire, with their number."""
    return fired(rows, rules, key, fields).groupBy(*key).agg(F.count(F.lit(1)).alias("n_rules")).where(F.col("n_rules") >= quorum)


def match_signatures(rows: DataFrame, rules: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    return fired(rows, rules, key, fields)


# --- addresses -----------------------------------------------------------------------------------

def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    p = F.split(ip, r"\.")
    n = sum((F.get(p, i).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), n)


def cidr_range(scope: DataFrame) -> DataFrame:
    """scope (cidr, kind) -> plus lo, hi and the /16 blocks it touches."""
    size = F.expr("shiftleft(cast(1 as bigint), 32 - cast(split_part(cidr, '/', 2) as int))")
    base = ip_number(F.split_part(F.col("cidr"), F.lit("/"), F.lit(1)))
    d = scope.withColumn("lo", base - F.pmod(base, size)).withColumn("hi", F.col("lo") + size - 1)
    return d.withColumn("b16", F.explode(F.sequence(F.expr("lo div 65536"), F.expr("hi div 65536"))))


def in_scope(targets: DataFrame, scope: DataFrame) -> DataFrame:
    """Targets (address) in an owned range and in no excluded one. Ranges join by /16 block, so neither side need be small."""
    t = targets.withColumn("_ip", ip_number(F.col("address"))).withColumn("_b", F.expr("_ip div 65536"))
    r = cidr_range(scope)
    inside = (F.col("_b") == F.col("b16")) & F.col("_ip").between(F.col("lo"), F.col("hi"))
    return t.join(r.where("kind = 'owned'"), inside, "left_semi").join(r.where("kind = 'excluded'"), inside, "left_anti").drop("_ip", "_b")


def anonymize(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})


def aggregate_flows(packets: DataFrame, key: tuple[str, ...] = ("from", "to", "protocol")) -> DataFrame:
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("total_bytes"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def prune(df: DataFrame, ts: str, now: Column, hours: int = 24, cap_hours: int = 168) -> DataFrame:
    """Rows younger than the time to live, which is a week at most."""
    return df.where(F.col(ts) > now - F.make_dt_interval(hours=F.lit(min(hours, cap_hours))))
