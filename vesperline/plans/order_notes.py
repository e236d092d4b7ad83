"""Annotated notes made from the driver's tables, and the same attributes as columns.

A customer is a note, an order a section of 22 lines. What a section says follows from its order alone, so SQL over the
tables gives what extraction must find, without reading any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES, HEAD = 22, 2
RU = {"Mon": "Пн", "Tue": "Вт", "Wed": "Ср", "Thu": "Чт", "Fri": "Пт", "Sat": "Сб", "Sun": "Вс"}


def attributes_sql(spark: bool, orders: str = "orders", more: str = "") -> str:
    """One row an order, in Spark SQL or in DuckDB's; ``orders`` may be a table with ``more`` columns."""
    day = (lambda d: f"date_format({d}, 'EEE')") if spark else (lambda d: f"strftime({d}, '%a')")
    s = (lambda x: f"cast({x} as string)") if spark else (lambda x: f"cast({x} as varchar)")
    plus = (lambda d, n: f"date_add({d}, {n})") if spark else (lambda d, n: f"cast({d} + {n} as date)")
    ru = "case " + " ".join(f"when {day('d')} = '{en}' then '{x}'" for en, x in RU.items()) + " end"
    return f"""
    select *,
      case when kind = 'CLOSED' or reps = '' then null else reps end as repeater,
      concat(case when kind = 'PLAIN' then '' else concat(kind, ': ') end, case when kind = 'CLOSED' then '[' else '<' end, {s('d')}, ' ', weekday, clock,
        case when kind = 'CLOSED' or reps = '' then '' else concat(' ', reps) end, warn, case when kind = 'CLOSED' then ']' else '>' end) as stamp,
      concat(case when kind = 'PLAIN' then '' else concat(kind, ': ') end, case when kind = 'CLOSED' then '[' else '<' end, {s('d')}, ' ', local_day, clock,
        case when kind = 'CLOSED' or reps = '' then '' else concat(' ', reps) end, warn, case when kind = 'CLOSED' then ']' else '>' end) as written,
      concat('CREATED: [', {s(plus('d', -3))}, ' ', {day(plus('d', -3))}, ']') as created
    from (
      select *, {HEAD} + 1 + {LINES} * (pos - 1) as line, {day('d')} as weekday, case when k % 9 = 0 then {ru} else {day('d')} end as local_day,
        case when k % 11 = 0 then null when o_orderstatus = 'O' then 'TODO' when o_orderstatus = 'F' then 'DONE' when k % 2 = 0 then 'CANCELLED' else 'CANCELED' end as state,
        case when k % 5 = 0 then null when k % 5 = 1 then {s('k % 65')} else chr(64 + cast(substr(o_orderpriority, 1, 1) as int)) end as priority,
        case k % 4 when 0 then 'SCHEDULED' when 1 then 'DEADLINE' when 2 then 'PLAIN' else 'CLOSED' end as kind,
        case when k % 3 <> 1 then '' when k % 6 = 1 then concat(' ', lpad({s('k % 23')}, 2, '0'), ':15-', lpad({s('k % 23 + 1')}, 2, '0'), ':45') else concat(' ', {s('k % 24')}, ':30') end as clock,
        case when k % 3 <> 1 then null when k % 6 = 1 then concat(lpad({s('k % 23')}, 2, '0'), ':15') else concat({s('k % 24')}, ':30') end as start_time,
        case when k % 6 = 1 then concat(lpad({s('k % 23 + 1')}, 2, '0'), ':45') end as end_time,
        case k % 7 when 0 then '+1w' when 1 then '.+2d' when 2 then '++1m' when 3 then '+1y' when 4 then '+3wd' when 5 then '++12h' else '' end as reps,
        case k % 7 when 0 then 'w' when 1 then 'd' when 2 then 'm' when 3 then 'y' when 4 then 'wd' when 5 then 'h' end as unit,
        case k % 7 when 0 then 1 when 1 then 2 when 2 then 1 when 3 then 1 when 4 then 3 when 5 then 12 end as n,
        case when k % 8 = 1 then concat(' -', {s('1 + k % 9')}, 'd') when k % 8 = 5 then ' -2w' else '' end as warn,
        case when k % 8 = 1 then 1 + k % 9 when k % 8 = 5 then 14 end as warning,
        case when k % 10 = 0 then concat({s(plus('d', 7))}, ', ', {s(plus('d', 14))}, case when k % 20 = 0 then ' later' else '' end) end as exdate,
        case when k % 10 = 3 and before is not null then case when k % 50 = 3 then concat('missing-', {s('k')}) else concat('order-', {s('before')}) end
             when k % 10 = 4 then 'alone' end as series,
        case when k % 10 = 3 and before is not null then concat({s(plus('before_d', 7))}, case when k % 30 = 3 then ' 9:05' when k % 30 = 13 then ' noon' else '' end) end as recurrence,
        case when k % 10 = 3 and before is not null then {plus('before_d', 7)} end as replaced
      from (
        select o_orderkey as k, o_custkey as c, cast(o_orderdate as date) as d, o_orderstatus, o_orderpriority, concat('c', {s('o_custkey')}, '.md') as file,
          row_number() over (partition by o_custkey order by o_orderkey) as pos, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before,
          lag(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderkey) as before_d{more}
        from {orders}
      ) o
    ) a"""


def clocks_sql(spark: bool) -> str:
    """One row a line item: a clock entry of its order; the seventh has no end."""
    s = (lambda x: f"cast({x} as string)") if spark else (lambda x: f"cast({x} as varchar)")
    day = f"{s('cast(l_shipdate as date)')}"
    minutes = "cast(l_quantity as int)"
    spent = f"concat('0:', lpad({s(minutes)}, 2, '0'))"
    return f"""
    select l_orderkey as k, l_linenumber as pos, concat({day}, ' 09:00') as clock_start, case when l_linenumber < 7 then concat({day}, ' 10:00') end as clock_end,
      case when l_linenumber < 7 then {spent} end as duration, case when l_linenumber < 7 then {minutes} end as minutes
    from lineitem"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("orders", "lineitem", "customer"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(attributes_sql(True))


#: The text of an order's clocks, as ``clocks_sql`` has them.
_CLOCKS = """array_join(transform(clocks, x -> concat('CLOCK: [', cast(x.d as string), ' 09:00]',
          coalesce(case when x.pos < 7 then concat('--[', cast(x.d as string), ' 10:00] => 0:', lpad(cast(x.q as string), 2, '0')) end, ''))), ' ')"""


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(root, file, text)``: a note for each customer who has orders, under the customer's market segment.

    Clocks meet their orders first, as numbers; then an order moves once more, to its customer, where all its text is made:
    in as many tasks as shuffles have, since reading the notes takes longer than their size suggests.
    """
    views(spark, sf_dir)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    return spark.sql(f"""
    with spent as (
      select l_orderkey as k, sort_array(collect_list(struct(l_linenumber as pos, cast(l_shipdate as date) as d, cast(l_quantity as int) as q))) as clocks
      from lineitem group by l_orderkey),
    clocked as (select /*+ REPARTITION({tasks}, o_custkey) */ o.*, clocks from orders o left join spent on o_orderkey = k),
    a as ({attributes_sql(True, "clocked", ", clocks")}),
    parts as (
      select a.file, a.c, a.k, concat_ws('\\n',
        concat('### ', coalesce(concat(state, ' '), ''), coalesce(concat('[#', priority, '] '), ''), 'Order ', a.k, ' *of* `', o_orderstatus, '`'), '',
        concat('`', written, '`'), concat('`', created, '`'), '',
        concat('Ship **order** ', a.k, ' to `someone` customer ', a.c), 'with [care](http://example.org/).', '',
        '```', concat('# TODO decoy ', a.k), '```', '',
        coalesce(concat('`', {_CLOCKS}, '`'), 'No clock.'), '',
        '```org-properties', concat('ID: order-', a.k), coalesce(concat('EXDATE: ', exdate), 'NOTE: none'), coalesce(concat('SERIES_ID: ', series), 'NOTE:  last '),
        coalesce(concat('RECURRENCE_ID: ', recurrence), case when a.k % 13 = 0 then 'no pair here' else '' end), '```', '', 'Second paragraph.') as section
      from a),
    written as (
      select c, max(file) as file, concat('# Notes of customer\\n\\n', array_join(sort_array(collect_list(struct(k, section))).section, '\\n')) as text
      from parts group by c)
    select c_mktsegment as root, file, text from written join customer on c = c_custkey""")
