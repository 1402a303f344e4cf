"""Column expressions shared by operators, detectors and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.thresholds import DEFAULTS, Thresholds

#: Orders of severity, of audit severity and of cipher strength.
SEVERITY = ("Low", "Medium", "High", "Critical")
AUDIT_SEVERITY = ("Info", "Warn", "Error", "Critical")
CIPHERS = ("null", "hmac-plain", "chacha20-poly1305")
#: Weakest cipher that a bond allows.
BOND_MINIMUM = {"Covalent": "null", "Metallic": "hmac-plain", "Ionic": "chacha20-poly1305"}
#: Methods that need no token.
PUBLIC_METHODS = ("health", "identity.get", "capabilities.list", "capability.list", "lifecycle.state", "lifecycle.status", "lifecycle.capabilities", "auth.check", "auth.mode", "auth.peer_info", "method_gate.status", "baseline.query", "baseline.anomaly", "security.advisory")
PUBLIC_PREFIXES = ("health.", "btsp.")
DEFAULT_PORT = 443


def rank_of(col: Column, order: tuple[str, ...]) -> Column:
    """Position of a name in its order, from 0; null for others (names themselves do not sort that way)."""
    return F.coalesce(*[F.when(col == name, F.lit(i)) for i, name in enumerate(order)])


def port_of(host: Column) -> Column:
    """Number after the last colon if it is a whole port number, else 443. Only what is neither a plain number there nor
    ends in a letter meets the pattern, which costs more than the rest of a log row."""
    port = lambda n: F.when(n.between(0, 65535), n).otherwise(F.lit(DEFAULT_PORT))
    tail = F.substring_index(host, ":", -1)
    plain = tail.try_cast("int")
    none = ~F.contains(host, F.lit(":")) | F.substring(host, -1, 1).between("A", "z")
    return F.when(none, DEFAULT_PORT).when(plain.cast("string") == tail, port(plain)).otherwise(port(F.regexp_extract(host, r":\+?0*([0-9]{1,5})$", 1).try_cast("int")))


def status_class(status: Column) -> Column:
    return F.when(status.between(400, 499), "4xx").when(status >= 500, "5xx").otherwise("ok")


def host_of(addr: Column) -> Column:
    """Address without what follows the last colon."""
    return F.regexp_replace(addr, ":[^:]*$", "")


def classify_method(method: Column) -> Column:
    public = method.isin(*PUBLIC_METHODS)
    for prefix in PUBLIC_PREFIXES:
        public = public | method.startswith(prefix)
    return F.when(public, "public").otherwise("protected")


def has_token(params: Column) -> Column:
    """Whether params._auth.token is a JSON string (a number or null is none)."""
    return F.coalesce(F.from_json(params, "_auth STRUCT<token: VARIANT>")["_auth"]["token"].cast("variant").isNotNull() & (F.schema_of_variant(F.from_json(params, "_auth STRUCT<token: VARIANT>")["_auth"]["token"]) == "STRING"), F.lit(False))


def origin_path(origin: Column) -> Column:
    """Layers that a connection of this origin passes."""
    ints = lambda *v: F.array(*[F.lit(i) for i in v])
    return F.when(origin == "Unix", ints(0)).when(origin == "Loopback", ints(1)).otherwise(ints(2, 3))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Absolute z-score. Without spread: infinity if x differs from the mean, null (never an anomaly) if not."""
    return F.when(std == 0, F.when(x != mean, F.lit(float("inf")))).otherwise(F.abs(x - mean) / F.nullif(std, F.lit(0.0)))


def exceeds(z: Column, limit: float) -> Column:
    """z > limit after rounding, so that an exact tie is a tie in every engine. Only what lies near the limit is rounded:
    Spark rounds by decimal objects."""
    return F.when(F.abs(z - F.lit(float(limit))) < 1e-6, F.round(z, 9) > limit).otherwise(z > limit)


def confidence(z: Column, th: Thresholds = DEFAULTS) -> Column:
    return F.least(z / (2 * th.sigma), F.lit(1.0))


def severity_of(z: Column, th: Thresholds = DEFAULTS) -> Column:
    return F.when(exceeds(z, th.high_deviation), "High").when(exceeds(z, th.medium_deviation), "Medium").otherwise("Low")


def norm_load(load1: Column, cpus: Column) -> Column:
    return F.least(load1 / F.greatest(cpus, F.lit(1)), F.lit(1.0))


def bytes_per_conn(volume: Column, rate: Column) -> Column:
    return F.when(rate > 0, volume / rate)


def behavior_text(dimension: Column, x: Column, mean: Column, std: Column) -> Column:
    """For people; numbers are the contract."""
    return F.format_string("%s %.2f deviates from mean %.2f (std %.2f)", dimension, x, mean, std)


def threat_id(prefix: str, *keys: Column) -> Column:
    """Prefix and a hash of the keys: the same threat has the same id in every run."""
    return F.concat(F.lit(prefix + "-"), F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256).substr(1, 16))


def threshold_fingerprint(th: Thresholds = DEFAULTS) -> Column:
    return F.format_string("sigma=%.2f;dos=%.2f;genetic=%.2f", F.lit(th.sigma), F.lit(th.load), F.lit(th.lineage_confidence))


def debug_option(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit('Some("'), col, F.lit('")')), F.lit("None"))


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def cipher_choice(offered: Column, bond: Column, has_key: Column, floor: str = "null") -> Column:
    """The cipher a session may use: strongest of those offered, or null if it misses the bond's or the server's minimum."""
    best = F.when(F.array_contains(offered, CIPHERS[2]), CIPHERS[2]).otherwise(CIPHERS[0])
    low = F.coalesce(*[F.when(bond == b, F.lit(CIPHERS.index(c))) for b, c in BOND_MINIMUM.items()], F.lit(0))
    ok = has_key & (rank_of(best, CIPHERS) >= low) & (rank_of(best, CIPHERS) >= CIPHERS.index(floor))
    return F.when(ok, best).otherwise(CIPHERS[0])


def offered_ciphers(params: Column) -> Column:
    """`ciphers` array, else the single `preferred_cipher`, else null cipher only."""
    p = F.from_json(params, "ciphers ARRAY<STRING>, preferred_cipher STRING")
    return F.coalesce(p["ciphers"], F.when(p["preferred_cipher"].isNotNull(), F.array(p["preferred_cipher"])), F.array(F.lit(CIPHERS[0])))


def advisory_reason(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" HTTP anomal"), F.when(n == 1, "y").otherwise("ies"), F.lit(" detected for source"))


def bypassed(expected: Column, actual: Column) -> Column:
    """Expected layers that the path misses, in order and with repeats."""
    return F.filter(expected, lambda x: ~F.array_contains(actual, x))


def suspicious_ports(ports: Column, th: Thresholds = DEFAULTS) -> Column:
    """Sensitive ports among those seen, with repeats."""
    return F.filter(ports, lambda p: p.isin(*th.sensitive_ports))
