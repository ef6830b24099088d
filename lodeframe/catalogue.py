"""Registered queries over the engine's own operators, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import Count, Fold, Max
from .operators import block_product, chunk_scan, group_by, index_join, index_select, materialize, merge_join, product, project, select, sort, table_scan
from .plans import estimate, planner
from .plans.ast import Term, column, constant
from .plans.parser import parse, parse_query
from .plans.planner import parquet_tables
from .plans.predicate import Predicate
from .session import Engine, connect
from .sources import Store
from .shared import shared_root

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def _dialect(name: str, text: str, sql: str | None = None, views: dict[str, str] | None = None) -> None:
    """A query in the engine's own dialect; the same text is its SQL unless one is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = parquet_tables(spark, sf_dir)
        return planner.plan(text, lambda t: (views or {}).get(t) or tables(t))

    _QUERIES[name], _SQL[name] = run, sql or text


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table_scan(spark, f"{sf_dir}/{name}.parquet")


def _eq(f: str, value: int | str) -> Term:
    return Term(column(f), constant(value))


# --- scans, projections, selections -----------------------------------------


@_query("select * from nation")
def table_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation")


_dialect("project_fields", "select o_orderkey, o_custkey from orders")
_dialect("project_dup_collapses", "select c_custkey, c_name, c_custkey from customer", "select c_custkey, c_name from customer")
_dialect("select_int_eq", "select p_partkey, p_name from part where p_size = 2")
_dialect("select_string_eq", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
_dialect("select_const_on_left", "select c_custkey, c_acctbal from customer where 'BUILDING' = c_mktsegment")
_dialect("select_conjunction", "select l_orderkey, l_partkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1")
_dialect("select_field_eq_field", "select l_orderkey, l_partkey from lineitem where l_partkey = l_suppkey")
_dialect("select_const_true", "select s_suppkey, s_name from supplier where 1 = 1")

# --- products, joins, views -------------------------------------------------

_dialect("product", "select r_name, n_name from region, nation")
_dialect("product_self_lhs_wins", "select r_name from region, region", "select a.r_name from region a cross join region b")
_dialect("product_select_join", "select o_orderkey, c_name, o_totalprice from orders, customer where o_custkey = c_custkey and c_mktsegment = 'BUILDING'")
_dialect("join_three_way", "select r_name, n_name, s_name from region, nation, supplier where r_regionkey = n_regionkey and n_nationkey = s_nationkey")
_dialect("join_disconnected", "select s_name, n_name, r_name from supplier, nation, region where s_nationkey = n_nationkey")
_dialect(
    "view_select",
    "select c_custkey, c_name from v where c_nationkey = 2",
    "select c_custkey, c_name from (select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING') v where c_nationkey = 2",
    {"v": "select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'"},
)
_dialect(
    "view_over_view_join",
    "select o_orderkey, c_name from v, customer where o_custkey = c_custkey",
    "select v.o_orderkey, c_name from (select o_orderkey, o_custkey from (select o_orderkey, o_custkey, o_orderpriority from orders where o_orderstatus = 'F') w where o_orderpriority = '1-URGENT') v, customer where v.o_custkey = c_custkey",
    {"w": "select o_orderkey, o_custkey, o_orderpriority from orders where o_orderstatus = 'F'", "v": "select o_orderkey, o_custkey from w where o_orderpriority = '1-URGENT'"},
)


@_query("select o_orderkey, o_totalprice from orders where o_custkey = 899")
def index_select_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(index_select(_t(spark, sf_dir, "orders"), "o_custkey", 899), ["o_orderkey", "o_totalprice"])


@_query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def index_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(index_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"), ["c_custkey", "c_name", "n_name"])


@_query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def merge_join_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(merge_join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"), ["o_orderkey", "l_linenumber", "l_quantity"])


@_query("select s_suppkey, r_regionkey from supplier cross join region")
def multibuffer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(block_product(_t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "region")), ["s_suppkey", "r_regionkey"])


@_query("select p_partkey, p_brand from part where p_type = 'ECONOMY'")
def materialized_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(materialize(project(select(_t(spark, sf_dir, "part"), [_eq("p_type", "ECONOMY")]), ["p_partkey", "p_brand", "p_type"])), ["p_partkey", "p_brand"])


# --- sorting and grouping ----------------------------------------------------


@_query("select * from nation order by n_name")
def sort_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort(_t(spark, sf_dir, "nation"), ["n_name"])


@_query("select c_mktsegment, c_custkey from customer order by c_mktsegment, c_custkey")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort(project(_t(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"]), ["c_mktsegment", "c_custkey"])


@_query("select o_orderstatus, count(*) as countofo_orderkey from orders group by o_orderstatus")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "orders"), ["o_orderstatus"], [Count("o_orderkey")])


@_query("select c_nationkey, max(c_custkey) as maxofc_custkey from customer group by c_nationkey")
def group_max_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "customer"), ["c_nationkey"], [Max("c_custkey")])


@_query("select n_regionkey, max(n_name) as maxofn_name from nation group by n_regionkey")
def group_max_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "nation"), ["n_regionkey"], [Max("n_name")])


@_query("select l_returnflag, l_linestatus, count(*) as countofl_orderkey, max(l_quantity) as maxofl_quantity from lineitem group by l_returnflag, l_linestatus")
def group_multi_key_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [Count("l_orderkey"), Max("l_quantity")])


@_query("select distinct p_brand from part")
def group_no_aggs_is_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "part"), ["p_brand"])


@_query("select count(*) as countofl_orderkey, max(l_quantity) as maxofl_quantity from lineitem having count(*) > 0")
def group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(_t(spark, sf_dir, "lineitem"), [], [Count("l_orderkey"), Max("l_quantity")])


@_query("select o_custkey, cast(sum(o_orderkey) as bigint) as sumofo_orderkey, count(*) as countofo_orderkey from orders group by o_custkey")
def group_user_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = Fold("o_orderkey", "sumofo_orderkey", T.LongType(), lambda v: v, lambda s, v: s + v)
    return group_by(_t(spark, sf_dir, "orders"), ["o_custkey"], [total, Count("o_orderkey")])


@_query(
    "select r_name, count(*) as countofo_orderkey, max(o_totalprice) as maxofo_totalprice from region, nation, customer, orders"
    " where r_regionkey = n_regionkey and n_nationkey = c_nationkey and c_custkey = o_custkey group by r_name"
)
def flagship_region_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select r_name, o_orderkey, o_totalprice from region, nation, customer, orders where r_regionkey = n_regionkey and n_nationkey = c_nationkey and c_custkey = o_custkey"
    return group_by(planner.plan(parse_query(text), parquet_tables(spark, sf_dir)), ["r_name"], [Count("o_orderkey"), Max("o_totalprice")])


# --- changes ------------------------------------------------------------------


@_query("select * from region union all select cast(5 as integer), 'OCEANIA'")
def insert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.inserted(_t(spark, sf_dir, "region"), parse("insert into region(r_regionkey, r_name) values (5, 'OCEANIA')"))


@_query("select * from nation union all select cast(25 as integer), '', cast(0 as integer)")
def insert_partial_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.inserted(_t(spark, sf_dir, "nation"), parse("insert into nation(n_nationkey) values (25)"))


@_query("select c_custkey, c_nationkey, case when c_nationkey = 2 then 'NONE' else c_mktsegment end as c_mktsegment from customer")
def update_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(planner.updated(_t(spark, sf_dir, "customer"), parse("update customer set c_mktsegment = 'NONE' where c_nationkey = 2")), ["c_custkey", "c_nationkey", "c_mktsegment"])


@_query("select p_partkey, p_size, p_brand, case when p_size = 2 then p_brand else p_type end as p_type from part")
def update_from_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(planner.updated(_t(spark, sf_dir, "part"), parse("update part set p_type = p_brand where p_size = 2")), ["p_partkey", "p_size", "p_brand", "p_type"])


@_query("select o_orderkey, o_orderstatus from orders where not (o_orderstatus = 'F')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(planner.deleted(_t(spark, sf_dir, "orders"), parse("delete from orders where o_orderstatus = 'F'")), ["o_orderkey", "o_orderstatus"])


def _database(spark: SparkSession) -> Store:
    """A database in the folder that all executors share."""
    return Store(spark, f"{shared_root(spark)}/lodeframe-db-{uuid.uuid4().hex}")


@_query("select cast(c_custkey as integer) as c_custkey, case when c_nationkey = 2 then 'NONE' else c_mktsegment end as c_mktsegment, c_nationkey from customer where c_nationkey <> 3 union all select cast(0 as integer), 'NEW', cast(0 as integer)")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, update, delete and insert on a stored table, each in a transaction, then a query."""
    store = _database(spark)
    for change in (
        lambda tx: tx.execute(parse("create table customer (c_custkey int, c_mktsegment varchar(10), c_nationkey int)")),
        lambda tx: tx.load("customer", _t(spark, sf_dir, "customer")),
        lambda tx: tx.execute(parse("update customer set c_mktsegment = 'NONE' where c_nationkey = 2")),
        lambda tx: tx.execute(parse("delete from customer where c_nationkey = 3")),
        lambda tx: tx.execute(parse("insert into customer (c_mktsegment) values ('NEW')")),
    ):
        tx = store.begin()
        change(tx)
        tx.commit()
    return store.begin().query("select c_custkey, c_mktsegment, c_nationkey from customer")


@_query("select * from (values ('member', 'mid', 4, 0, 0), ('member', 'mname', 12, 10, 4)) as t(tblname, fldname, type, length, \"offset\")")
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _database(spark)
    tx = store.begin()
    tx.execute(parse("create table member (MId int, MName varchar(10))"))
    tx.commit()
    return store.begin().query("select tblname, fldname, type, length, offset from fldcat")


def _loaded(spark: SparkSession, sf_dir: str, table: str, fields: str) -> Engine:
    """An engine whose database holds one of the tables, loaded."""
    engine = Engine(spark, _database(spark).files.root)
    engine.execute(f"create table {table} ({fields})")
    tx = engine.store.begin()
    tx.load(table, _t(spark, sf_dir, table))
    tx.commit()
    return engine


@_query(
    "select n_name, n_regionkey, 'n_name 12 25, n_regionkey 4 6' as described from nation where n_regionkey = 2 and n_nationkey <> 8"
    " union all select 'ATLANTIS', 2, 'n_name 12 25, n_regionkey 4 6'"
)
def client_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connect, change, read by cursor and metadata, and commit, as a client does."""
    root = _loaded(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int").store.files.root
    client = connect(spark, root)
    client.create_statement().execute_update("insert into nation (n_nationkey, n_name, n_regionkey) values (25, 'ATLANTIS', 2)")
    client.create_statement().execute_update("delete from nation where n_nationkey = 8")
    found = client.create_statement().execute_query("select n_name, n_regionkey from nation where n_regionkey = 2")
    meta, rows = found.get_meta_data(), []
    described = ", ".join(f"{meta.get_column_name(i)} {meta.get_column_type(i)} {meta.get_column_display_size(i)}" for i in range(1, meta.get_column_count() + 1))
    while found.next():
        rows.append((found.get_string("n_name"), found.get_int("n_regionkey"), described))
    found.close()
    client.close()
    return spark.createDataFrame(rows, "n_name string, n_regionkey int, described string")


@_query("select c_custkey, c_name, 'select c_custkey, c_name from customer where c_nationkey = 2' as viewdef from customer where c_nationkey = 2")
def stored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is stored, queried by name, and listed in the catalog."""
    engine = _loaded(spark, sf_dir, "customer", "c_custkey int, c_name varchar(25), c_nationkey int")
    engine.execute("create view second as select c_custkey, c_name from customer where c_nationkey = 2")
    return engine.query("select c_custkey, c_name, viewdef from second, viewcat where viewname = 'second'")


@_query("select o_orderkey, 'by_customer' as indexname, 'o_custkey' as fieldname from orders where o_custkey = 899")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index on a clustered table: an equality reads the segments whose ranges have the value."""
    engine = _loaded(spark, sf_dir, "orders", "o_orderkey int, o_custkey int")
    engine.execute("create index by_customer on orders (o_custkey)")
    tx = engine.store.begin()
    tx.cluster("orders", "o_custkey", segments=4)
    tx.commit()
    return engine.query("select o_orderkey, indexname, fieldname from orders, idxcat where o_custkey = 899 and tablename = 'orders'")


@_query("select * from (values ('tblcat', 1), ('fldcat', 3), ('viewcat', 1), ('idxcat', 1)) as t(catalog, n)")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in each table of the catalog, after one table, view and index were made."""
    engine = Engine(spark, _database(spark).files.root)
    for text in ("create table t (a int, b varchar(3), c int)", "create view v as select a from t", "create index i on t (a)"):
        engine.execute(text)
    tx = engine.store.begin()
    return spark.createDataFrame([(name, tx.query(f"select {field} from {name}").count()) for name, field in (("tblcat", "tblname"), ("fldcat", "fldname"), ("viewcat", "viewname"), ("idxcat", "indexname"))], "catalog string, n int")


@_query("select c_custkey, c_name, c_acctbal from customer where c_nationkey between 3 and 7")
def chunk_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a table's files, in their order."""
    root = f"{shared_root(spark)}/lodeframe-chunks-{uuid.uuid4().hex}"
    _t(spark, sf_dir, "customer").write.partitionBy("c_nationkey").parquet(root)
    return project(chunk_scan(spark, [f"{root}/c_nationkey={k}" for k in range(25)], 3, 7), ["c_custkey", "c_name", "c_acctbal"])


@_query("select c_custkey, n_name, 'BUILDING' as segment, 'n_nationkey' as other from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' and n_regionkey = 1")
def predicate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction taken apart by schema: each table's own terms, those that join them, and what fields are bound to."""
    customer, nation = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    p = Predicate((_eq("c_mktsegment", "BUILDING"), Term(column("c_nationkey"), column("n_nationkey")), Term(constant(1), column("n_regionkey"))))
    left, right = set(customer.columns), set(nation.columns)
    rows = select(product(select(customer, p.within(left)), select(nation, p.within(right))), p.joining(left, right))
    bound = rows.withColumns({"segment": F.lit(p.constant_for("c_mktsegment")), "other": F.lit(p.field_for("c_nationkey"))})
    return project(bound, ["c_custkey", "n_name", "segment", "other"])


@_query("select 'o_custkey = 899' as predicate, 1 + n // 3 as factor, n // (1 + n // 3) as records from (select count(*) as n from orders) union all select 'o_custkey = o_orderkey and 1 = 1', 1 + n // 3, n // (1 + n // 3) from (select count(*) as n from orders)")
def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much selections are estimated to divide a table, and the records they leave."""
    orders = _t(spark, sf_dir, "orders")
    e = estimate.table(orders.count(), set(orders.columns), 100)
    both = Predicate((Term(column("o_custkey"), column("o_orderkey")), Term(constant(1), constant(1))))
    one = Predicate((_eq("o_custkey", 899),))
    # two fields: the larger of both numbers of values
    factors = [(p, estimate.reduction(e, p)) for p in (one, both)]
    return spark.createDataFrame([(str(p), f, estimate.select(e, p).records) for p, f in factors], "predicate string, factor long, records long")


@_query(
    "select available, size, case when available <= 1 then 1 else ceil(pow(size, 1.0 / list_filter(range(2, 60), lambda i: ceil(pow(size, 1.0 / i)) <= available)[1]))::int end as root,"
    " ceil(size / ceil(size / greatest(1, available)))::int as factor from (values (0, 10), (1, 10), (8, 100), (8, 6), (3, 1000), (20, 300)) as t(available, size)"
)
def buffer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root and the fraction of an output's blocks that available buffers hold."""
    cases = [(0, 10), (1, 10), (8, 100), (8, 6), (3, 1000), (20, 300)]
    return spark.createDataFrame([(a, n, estimate.best_root(a, n), estimate.best_factor(a, n)) for a, n in cases], "available int, size int, root int, factor int")


# --- statistics ---------------------------------------------------------------


@_query("select 'orders' as tblname, count(*) as numrecs, 1 + count(*) // 3 as distinctvals from orders union all select 'nation', count(*), 1 + count(*) // 3 from nation")
def stat_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("orders", "nation"):
        df = _t(spark, sf_dir, name)
        e = estimate.table(df.count(), set(df.columns), 100)
        rows.append((name, e.records, e.distinct(df.columns[0])))
    return spark.createDataFrame(rows, "tblname string, numrecs long, distinctvals long")


@_query("select (r1 * r2) // greatest(1 + r1 // 3, 1 + r2 // 3) as recordsoutput from (select count(*) as r1 from orders), (select count(*) as r2 from customer)")
def estimate_join_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (estimate.table(df.count(), set(df.columns), 100) for df in (_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")))
    return spark.createDataFrame([(estimate.merge_join(a, b, "o_custkey", "c_custkey").records,)], "recordsoutput long")


#: The names of the survey's catalogue.
_NAMES = {"table_scan_all": "table_scan", "index_select_eq": "index_select", "index_join_lookup": "index_join", "merge_join_sorted": "merge_join", "materialized_selection": "materialize", "chunk_scan_files": "chunk_scan"}


def queries() -> dict[str, Query]:
    return {_NAMES.get(k, k): f for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {_NAMES.get(k, k): s for k, s in _SQL.items()}
