"""Deterministic SQL that gives the plain tables the shape of executable metadata.

The same text runs on Spark and on the engine that checks it; {table} stands for a table's name.
"""

import re

FUNC = """
SELECT l_orderkey * 8 + l_linenumber AS func_off, l_suppkey AS image_no, CAST(l_partkey % 10 AS INT) AS shape,
       CASE CAST(l_partkey % 10 AS INT)
         WHEN 0 THEN concat('runtime.fn', CAST(l_suppkey AS STRING))
         WHEN 1 THEN concat('net/http.(*Client', CAST(l_suppkey % 7 AS STRING), ').Do')
         WHEN 2 THEN concat('github.com/acme/mod', CAST(l_suppkey % 9 AS STRING), '.(*Map[K, V]).Len')
         WHEN 3 THEN concat('gopkg.in/yaml.v', CAST(l_linenumber AS STRING), '.Marshal')
         WHEN 4 THEN concat('main.main.func', CAST(l_linenumber AS STRING))
         WHEN 5 THEN 'time.Time.String'
         WHEN 6 THEN concat('internal/abi.f', CAST(l_partkey AS STRING))
         WHEN 7 THEN concat('ab12cd3', CAST(l_suppkey % 10 AS STRING), '.x')
         WHEN 8 THEN CASE WHEN l_linenumber = 1 THEN 'runtime.cgocall' ELSE 'runtime.newproc' END
         ELSE concat('noslash', CAST(l_partkey AS STRING)) END AS name,
       CAST(l_orderkey % 100000 AS BIGINT) AS entry_offset, CAST(l_quantity AS INT) AS start_line,
       CAST(l_partkey % 101 AS INT) AS func_id, CAST(l_suppkey % 8 AS INT) AS flags,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) ELSE CAST(0 AS BIGINT) END AS deferreturn
FROM {lineitem}
"""

#: Deltas of a PC-value table per user; a PC delta of 0 ends it.
PCD = """
SELECT user_id, event_id, event_id % 7 - 3 AS vdelta,
       CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 5 + 1 END AS pc_delta FROM {events}
"""

#: Lines of module text, one per event.
MOD = """
SELECT user_id, event_id AS ln,
       CASE event_type WHEN 'click' THEN 'dep' WHEN 'view' THEN '=>' WHEN 'error' THEN 'build' ELSE 'path' END AS tag,
       CASE event_type
         WHEN 'click' THEN concat('dep\t', CAST(event_id % 13 AS STRING), '\tv1.', CAST(event_id AS STRING), '.0\th1:x=')
         WHEN 'view' THEN concat('=>\t./r', CAST(event_id AS STRING))
         WHEN 'error' THEN concat('build\tk', CAST(event_id % 5 AS STRING), '=v=', CAST(event_id AS STRING))
         ELSE concat('path\tp', CAST(event_id AS STRING)) END AS line
FROM {events}
"""

SEG = """
SELECT p_partkey % 25 AS image_id, p_partkey AS ord, p_partkey * 1000 AS va, p_partkey * 512 AS file_off, CAST(700 AS BIGINT) AS size
FROM {part}
"""
#: Addresses and offsets spread over all that the segments cover.
ADDR = "SELECT event_id, event_id % 25 AS image_id, event_id * 7919 % ((SELECT max(p_partkey) FROM {part}) * 1000) AS va FROM {events}"
OFFSET = "SELECT event_id, event_id % 25 AS image_id, event_id * 7919 % ((SELECT max(p_partkey) FROM {part}) * 512) AS file_off FROM {events}"

TEXT = """
SELECT concat('d', CAST(doc_id AS STRING)) AS id,
       CASE doc_id % 5 WHEN 0 THEN concat(text, ' runtime.main x runtime.goexit runtime.newproc')
                       WHEN 1 THEN concat(text, ' runtime.gopanic') ELSE text END AS text FROM {documents}
UNION ALL SELECT concat('p', CAST(page_id AS STRING)), html FROM {pages}
UNION ALL SELECT concat('c', CAST(conv_id * 1000 + turn AS STRING)), text FROM {conversations}
"""

TYPE = """
SELECT p_partkey AS type_va, CAST(p_partkey % 27 AS INT) AS kind_code,
       concat(CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '' END,
              CASE p_partkey % 5 WHEN 1 THEN '[]' WHEN 2 THEN '[4]*' WHEN 3 THEN 'map[' ELSE '' END,
              lower(replace(p_brand, '#', '')), '.', p_name) AS name,
       CAST(p_size AS BIGINT) AS size, p_partkey * 7 % 2000 AS elem_va
FROM {part}
"""
ITAB = """
SELECT s_suppkey * 16 AS itab_va, CAST(s_nationkey * 27 + 20 AS BIGINT) AS iface_type_va, s_suppkey * 11 % 2000 AS concrete_type_va FROM {supplier}
"""
VERSION = """
SELECT o_orderkey, CASE o_orderkey % 6
         WHEN 0 THEN concat('go1.', CAST(o_orderkey % 30 AS STRING), '.', CAST(o_orderkey % 7 AS STRING))
         WHEN 1 THEN concat('go1.', CAST(o_orderkey % 30 AS STRING))
         WHEN 2 THEN concat('go1.', CAST(o_orderkey % 30 AS STRING), 'rc1')
         WHEN 3 THEN concat('devel go1.23-abc', CAST(o_orderkey + 10000 AS STRING), ' x')
         WHEN 4 THEN 'TinyGo0.3' ELSE NULL END AS version,
       CASE o_orderkey % 11 WHEN 0 THEN 'gc' WHEN 1 THEN 'gccgo' WHEN 2 THEN 'tinygo' WHEN 3 THEN 'other' ELSE NULL END AS named,
       o_orderkey % 4 = 0 AS has_table
FROM {orders}
"""
GARBLE = """
SELECT l_suppkey AS image_no,
       CASE WHEN l_partkey % 3 = 0 THEN concat('ab12cd', CAST(l_suppkey % 10 AS STRING), CAST(l_linenumber AS STRING), '.f')
            ELSE concat('pkg', CAST(l_partkey % (l_suppkey % 20 + 1) AS STRING), '.f') END AS name,
       l_suppkey % 3 <> 0 AS scrubbed
FROM {lineitem}
"""
SOURCE = """
SELECT page_id, CASE page_id % 4
         WHEN 0 THEN concat('/usr/go/src/p', CAST(page_id % 7 AS STRING), '/q/f', CAST(page_id AS STRING), '.go')
         WHEN 1 THEN concat('/home/u/src/f', CAST(page_id AS STRING), '.go')
         WHEN 2 THEN concat('/opt/libexec/src/f', CAST(page_id AS STRING), '.go')
         ELSE concat('GOROOT/f', CAST(page_id % 3 AS STRING), '.go') END AS path FROM {pages}
"""
RUNS = "SELECT event_id, event_id * 7919 % 1000 AS v FROM {events}"
TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey < 3 THEN NULL ELSE CAST(floor(p_partkey / 3) AS BIGINT) END AS parent FROM {part}"


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def on(spark, sf_dir: str, sql: str):
    """The adapter's rows as a DataFrame."""
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))
