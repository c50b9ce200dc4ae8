"""Queries by name, each with the SQL that computes the same in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlane.sources.domain import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shared SQL: the domain tables of arborlane.sources.domain.
EDGES = """edges as (
  select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem
  union select 'p' || l_partkey, 's' || l_suppkey from lineitem
  union select 'o' || o_orderkey, 'c' || o_custkey from orders
  union select 'c' || c_custkey, 'n' || c_nationkey from customer
  union select 's' || s_suppkey, 'n' || s_nationkey from supplier
  union select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""
TARGETS = "targets as (select distinct name, substr(name, 1, 1) as kind from (select src as name from edges union select dst from edges))"
ACTIONS = """actions as (
  select 'o' || l_orderkey || '#' || row_number() over w as id, 'o' || l_orderkey as target, l_returnflag || l_linestatus as kind,
         'p' || l_partkey as path, cast(l_quantity as bigint) as duration, row_number() over w as pos
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))"""
JOURNAL = """journal as (
  select event_id as seq, user_id || ':' || event_type as id, event_type as kind, props as key, cast(floor(value) as bigint) as duration, ts, user_id from events)"""
RESULTS = """results as (
  select event_id as pos, 'a' || event_id as id, 'k' || (user_id % 7) as kind,
    case event_type when 'purchase' then 'executed' when 'click' then 'cached' when 'view' then 'skipped' when 'error' then 'failed' when 'signup' then 'flaky' else 'wouldrun' end as outcome,
    cast(floor(value) as bigint) as duration, 'input changed: f' || (event_id % 11) as reason, props as detail, user_id from events)"""
SNAPS = """snap_a as (select o_orderkey as id, o_orderstatus as status, o_orderpriority as priority, cast(round(o_totalprice * 100) as bigint) as cents from orders where o_orderkey % 10 <> 0),
snap_b as (select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 7 = 0 then o_orderpriority || '!' else o_orderpriority end as priority,
  case when o_orderkey % 21 = 0 then 0 else cast(round(o_totalprice * 100) as bigint) end as cents from orders where o_orderkey % 10 <> 1)"""
BLOBS = "blobs as (select doc_id as id, sha256(coalesce(text, '')) as digest, cast(strlen(coalesce(text, '')) as bigint) as bytes, source, lang from documents)"


def query(name: str, sql: str | None = None):
    """Registers f(tables) as a query."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add
