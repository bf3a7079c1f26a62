"""Market-data views over the generic star-schema test tables.

One expression list per view serves both engines: ``bind`` evaluates it with Spark and
``bind_sql`` renders it as a common table expression for the comparison database. The macros
``US(col)`` (epoch microseconds) and ``JK`` (the integer ``k`` of an event's JSON properties)
are the only dialect differences. Every view keeps all rows its base table holds.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_US = 1706659200000000  # 2024-01-31 00:00:00 UTC, end of the event stream
ORDERS_AS_OF_US = 1004918400000000  # 2001-11-05 00:00:00 UTC, end of orders and lineitem
US = 1_000_000
HOUR_US = 3600 * US
DAY_US = 24 * HOUR_US

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_MARKET_OF_EVENT = "cast(floor(user_id / 50) as bigint) * 20 + JK % 20"
_OUTCOME = "case when JK % 3 = 0 then 'NO' else 'YES' end"
_PRICE = "cast((JK * 7 + event_id) % 97 + 1 as double) / 100"
_WALLET = "'0x' || lpad(cast({} as string), 40, '0')"
_TOKEN = "'t' || cast({} as string) || case when {} = 'NO' then 'n' else 'y' end"

_MONTH_DAY = (
    "case p_partkey % 4 when 0 then 'april-30' when 1 then 'may-31' when 2 then 'june-30' else 'july-31' end"
)
_GROUP = "cast(cast(floor(p_partkey / 20) as bigint) as string)"
_SLUG = f"""case
 when p_partkey % 20 >= 16 then 'btc-updown-5m-' || cast(1706659200 + 300 * (p_partkey % 5000) as string)
 when p_partkey % 20 < 4 then 'topic-' || {_GROUP} || '-by-' || {_MONTH_DAY}
 when p_partkey % 20 < 8 then 'trump-tariff-' || {_GROUP} || '-by-' || {_MONTH_DAY}
 when p_partkey % 20 < 12 then 'nba-team' || {_GROUP} || '-vs-team' || cast(p_partkey as string)
 when p_partkey % 20 = 12 then 'nba-champion-2026-' || {_GROUP}
 when p_partkey % 20 = 13 then 'trump-beats-rival-' || {_GROUP}
 when p_partkey % 20 = 14 then 'us-iran-meeting-held-' || {_GROUP}
 else 'senate-attack-vote-' || {_GROUP} end"""

VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "trades": (
        "events",
        [
            "event_id",
            "US(ts) as ts_us",
            f"{_WALLET.format('user_id')} as wallet",
            f"'m' || cast({_MARKET_OF_EVENT} as string) as market_id",
            f"{_TOKEN.format(_MARKET_OF_EVENT, _OUTCOME)} as asset_id",
            "case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side",
            f"{_OUTCOME} as outcome",
            f"{_PRICE} as price",
            "value as size",
            f"round(value * ({_PRICE}), 4) as usd",
            "case when event_type = 'error' then 'CANCELLED' else 'MATCHED' end as status",
            "'0x' || md5(cast(event_id as string)) as tx_hash",
            "event_type",
        ],
        None,
    ),
    "quotes": (
        "events",
        [
            "event_id",
            "US(ts) as ts_us",
            f"'m' || cast({_MARKET_OF_EVENT} as string) as market_id",
            f"{_TOKEN.format(_MARKET_OF_EVENT, _OUTCOME)} as asset_id",
            f"{_PRICE} - 0.02 as bid",
            f"{_PRICE} + cast(JK % 10 as double) / 100 as ask",
            "value as bid_size",
            "value * cast(JK % 7 as double) / 4 as ask_size",
        ],
        "event_type = 'view'",
    ),
    "lead_trades": (
        "events",
        [
            "event_id",
            "US(ts) as ts_us",
            "case when user_id % 2 = 0 then 'BTC' else 'ETH' end || cast(cast(floor(user_id / 50) as bigint) as string) as coin",
            "case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side",
            f"{_PRICE} as price",
            "value as size",
        ],
        None,
    ),
    "lead_quotes": (
        "events",
        [
            "event_id",
            "US(ts) as ts_us",
            "case when user_id % 2 = 0 then 'BTC' else 'ETH' end || cast(cast(floor(user_id / 50) as bigint) as string) as coin",
            f"({_PRICE} * 2 + 0.01) / 2 as mid",
        ],
        "event_type = 'view'",
    ),
    "markets": (
        "part",
        [
            "p_partkey as market_no",
            "'m' || cast(p_partkey as string) as market_id",
            f"{_SLUG} as slug",
            "case when p_partkey % 20 >= 16 then 'Will Bitcoin rise in the next 5 minutes?' else p_name end as question",
            "case when p_partkey % 20 in (8, 9) then 'Sports' when p_partkey % 20 = 12 then 'Basketball' "
            "when p_partkey % 20 in (4, 5, 6, 7) then 'Politics' else p_type end as category",
            "'t' || cast(p_partkey % 5 + 1 as string) as tier",
            f"{AS_OF_US} + case when p_partkey % 20 >= 16 then (p_partkey * 37 % 3000) * {US} "
            f"else ((p_partkey * 13) % 60 - 5) * {DAY_US} end as end_us",
            "cast(p_partkey * 37 % 101 as double) / 100 as best_bid",
            "cast(p_partkey * 37 % 101 as double) / 100 + cast(p_partkey % 9 + 1 as double) / 50 as best_ask",
            "round(p_retailprice * (p_partkey % 13), 2) as volume",
            "p_partkey % 11 <> 0 as active",
            "p_partkey % 17 = 0 as closed",
            "case p_partkey % 4 when 3 then null "
            "when 2 then '[[\"t' || cast(p_partkey as string) || 'y\", \"t' || cast(p_partkey as string) || 'n\"]]' "
            "else '[\"t' || cast(p_partkey as string) || 'y\", \"t' || cast(p_partkey as string) || 'n\"]' end as token_ids",
            "case when p_partkey % 5 = 0 then null else p_partkey * 31 % 600 end as fee_bps",
            "p_brand as brand",
        ],
        None,
    ),
    "link_map": (
        "part",
        [
            "'m' || cast(p_partkey as string) as market_id",
            "'T' || cast(p_partkey as string) || 'Y' as token_id",
            f"case p_partkey % 7 when 0 then null when 1 then '' when 2 then 'unknown' else {_SLUG} end as event_slug",
            f"case p_partkey % 9 when 0 then null when 1 then 'm' || cast(p_partkey as string) || '...' else {_SLUG} end as market_slug",
            "case when p_partkey % 6 = 0 then null else '0xc' || cast(p_partkey as string) end as condition_id",
            "'t' || cast(p_partkey % 5 + 1 as string) as market_tier",
            "case p_partkey % 3 when 0 then 'api' when 1 then 'fallback' else 'stale' end as source",
            f"{AS_OF_US} - (p_partkey * 7 % 40) * {DAY_US} as fetched_us",
        ],
        None,
    ),
    "observations": (
        "events",
        [
            "event_id as obs_id",
            "US(ts) as ts_us",
            f"{_WALLET.format('user_id')} as address",
            f"'m' || cast({_MARKET_OF_EVENT} as string) as market_id",
            f"{_TOKEN.format(_MARKET_OF_EVENT, _OUTCOME)} as asset_id",
            "case when event_type = 'signup' then 'whale_scan' else 'clob_trade' end as obs_type",
            "'{\"side\": \"' || case when event_id % 2 = 0 then 'BUY' else 'SELL' end || '\", \"price\": ' || "
            "cast((JK * 7 + event_id) % 97 + 1 as string) || case when event_id % 3 = 0 then ', \"size\": ' else ', \"amount\": ' end || "
            "cast(event_id % 900 as string) || ', \"outcome\": \"' || case when JK % 3 = 0 then 'No' else 'Yes' end || '\"}' as payload_json",
        ],
        None,
    ),
    "entities": (
        "customer",
        [
            f"{_WALLET.format('c_custkey')} as wallet",
            "'ve_' || cast(c_nationkey as string) as entity_id",
            "round(least(0.95, abs(c_acctbal) / 10000), 4) as insider_score",
            "round(least(95.0, abs(c_acctbal) / 100), 2) as trust_score",
            "c_mktsegment as primary_tag",
            "c_custkey % 40 as sample_size",
            f"{AS_OF_US} - (c_custkey * 11 % 90) * {DAY_US} as updated_us",
        ],
        None,
    ),
    "funding": (
        "customer",
        [
            f"{_WALLET.format('c_custkey')} as wallet",
            f"{_WALLET.format('900000 + cast(floor(c_custkey / 6) as bigint)')} as root_a",
            "case when c_custkey % 4 = 0 then null else "
            f"{_WALLET.format('800000 + cast(floor(c_custkey / 5) as bigint)')} end as root_b",
            "c_mktsegment as label",
            "c_nationkey as nation",
        ],
        None,
    ),
    "executions": (
        "lineitem",
        [
            "md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
            "cast(l_suppkey as string), cast(cast(l_quantity as bigint) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))) as execution_id",
            "l_orderkey as order_no",
            "'m' || cast(l_partkey as string) as market_id",
            "'t' || cast(l_suppkey % 5 + 1 as string) as tier",
            "case when l_linestatus = 'O' then 'PAPER' else 'LIVE' end as mode",
            "case l_suppkey % 4 when 0 then 'fast_gate_ok' when 1 then 'low_ev' when 2 then 'latency' else 'no_price' end as reason",
            "case l_returnflag when 'R' then 'NEGATIVE_EV' when 'A' then 'PASS' else 'PASS_DEGRADED' end as gate_reason",
            "case when l_returnflag <> 'R' then 1 else 0 end as accepted",
            "round(l_discount - 0.05, 4) as ev_net",
            "least(0.999, l_tax * 10 + 0.1) as posterior",
            "l_quantity as qty",
            "round(l_discount * 9 + 0.05, 4) as entry_price",
            "US(l_shipdate) as created_us",
        ],
        None,
    ),
    "settlements": (
        "orders",
        [
            "o_orderkey as trade_id",
            "'m' || cast(o_custkey as string) as market_id",
            "case when o_orderkey % 2 = 0 then 'YES' else 'NO' end as direction",
            "cast(o_custkey % 9 as string) as strategy",
            "o_orderpriority as reason",
            "cast(o_orderkey % 90 + 5 as double) / 100 as entry_price",
            "case when o_orderstatus = 'P' then null else cast(o_orderkey % 97 + 1 as double) / 100 end as exit_price",
            "round(o_totalprice / 100, 4) as position_usd",
            "round((o_totalprice - 250000) * 0.9, 3) as est",
            "round(o_totalprice - 250000, 2) as pnl",
            "US(o_orderdate) as closed_us",
        ],
        None,
    ),
    "holdings": (
        "orders",
        [
            "o_orderkey as position_id",
            "'m' || cast(o_custkey as string) as market_id",
            "case when o_custkey % 10 = 9 then null else 'c' || cast(o_custkey % 40 as string) end as cluster_id",
            "case when o_orderkey % 2 = 0 then 'YES' else 'NO' end as side",
            "case when o_orderkey % 2 = 0 then 1 else -1 end * round(o_totalprice / 1000, 5) as signed_usd",
            "round(o_totalprice / 10000000, 9) as kelly",
            "cast(o_orderkey % 90 + 5 as double) / 100 as entry_price",
            "round(o_totalprice / 100, 4) as size",
            "US(o_orderdate) as opened_us",
        ],
        "o_orderstatus = 'O'",
    ),
}

_SPARK_US = r"unix_micros(cast(\1 as timestamp))"
_DUCK_US = r"epoch_us(\1)"
_SPARK_K = "cast(get_json_object(props, '$.k') as bigint)"
_DUCK_K = "cast(json_extract_string(props, '$.k') as bigint)"


def _render(expr: str, us: str, k: str) -> str:
    return re.sub(r"\bJK\b", k, re.sub(r"US\((\w+)\)", us, expr))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one base table; the session is pinned to UTC so stored times keep their meaning."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Stored time column of the base tables whose views carry an event time.
STORED_TIME = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}


def bind(spark: SparkSession, sf_dir: str, view: str, since_us: int | None = None) -> DataFrame:
    """One view; ``since_us`` also bounds the stored time column, so that the scan itself skips older rows."""
    base, exprs, where = VIEWS[view]
    df = load(spark, sf_dir, base)
    if since_us is not None:
        stored = STORED_TIME[base]
        since = datetime.fromtimestamp(since_us // US, UTC).replace(tzinfo=None)
        df = df.filter(F.col(stored) >= F.lit(since.isoformat(" ")).cast(df.schema[stored].dataType))
    if where:
        df = df.filter(where)
    return df.selectExpr(*[_render(e, _SPARK_US, _SPARK_K) for e in exprs])


def bind_stream(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The same view over its base table read as a file stream."""
    from tapewatch.streaming.jobs import event_stream

    base, exprs, where = VIEWS[view]
    schema = load(spark, sf_dir, base).schema
    # A glob matches both one Parquet file and a folder of them.
    df = event_stream(spark, f"{sf_dir}/{{{base}.parquet}}", schema)
    if where:
        df = df.filter(where)
    return df.selectExpr(*[_render(e, _SPARK_US, _SPARK_K) for e in exprs])


def bind_sql(view: str) -> str:
    base, exprs, where = VIEWS[view]
    cols = ", ".join(_render(e, _DUCK_US, _DUCK_K) for e in exprs)
    tail = f" WHERE {where}" if where else ""
    return f"{view} AS (SELECT {cols} FROM {base}{tail})"


def with_views(body: str) -> str:
    """Prefix a comparison query with the view definitions it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ", ".join(bind_sql(v) for v in used)
    body = body.strip()
    if not used:
        return body
    recursive = re.match(r"(?i)with\s+recursive\s+", body)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[recursive.end():]}"
    leading = re.match(r"(?i)with\s+", body)
    if leading:
        return f"WITH {ctes}, {body[leading.end():]}"
    return f"WITH {ctes} {body}"
