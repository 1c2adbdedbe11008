"""Input corpora for the driver queries, derived from the given tables.

DOC reads the ``documents`` table as files. CODE is a code-like corpus written from
``documents`` (the text as a comment, a configuration or a note) by SQL that runs
unchanged in Spark and DuckDB: twenty files per project, so it grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans.scale import staging_dir
from sievework.rules import PREFIXES
from sievework.sources import files_from, spread_small, write_tree

AS_OF_EPOCH = 1704067200

CODE_SQL = """
SELECT 'p' || CAST(k AS STRING) AS project, k, i, doc_id,
  CASE i WHEN 0 THEN 'package.json'
         WHEN 1 THEN CASE WHEN k % 4 = 0 THEN 'notes.txt' ELSE 'package-lock.json' END
         WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'requirements.txt' ELSE 'main.py' END
         WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 'README.md' ELSE '.gitignore' END
         WHEN 4 THEN CASE WHEN k % 2 = 0 THEN '.env' ELSE 'env.txt' END
         WHEN 5 THEN CASE WHEN k % 6 = 0 THEN '.env.example' ELSE 'TODO.md' END
         WHEN 9 THEN 'src/loop.py'
         WHEN 10 THEN 'migrations/001.sql'
         WHEN 11 THEN 'src/api.js'
         WHEN 12 THEN 'src/keys.js'
         WHEN 13 THEN 'tests/keys.test.js'
         WHEN 14 THEN 'src/dup.py'
         WHEN 15 THEN 'src/dup.js'
         WHEN 16 THEN 'node_modules/x/index.js'
         WHEN 17 THEN 'src/insecure.py'
         WHEN 18 THEN 'src/client.ts'
         WHEN 19 THEN 'config/app.yaml'
         ELSE 'src/m' || CAST(i AS STRING) || '.ts' END AS path,
  CASE i
    WHEN 0 THEN '{"name":"p' || CAST(k AS STRING) || '","dependencies":{"lodash":"4.17.' || CAST(k % 25 AS STRING)
             || '","react":"^18.' || CAST(k % 3 AS STRING) || '.0","axios":"' || CAST(k % 2 AS STRING) || '.2.0"}'
             || ',"description":"' || plain || '"' || CASE WHEN k % 3 = 0 THEN ',"engines":{"node":"20"}' ELSE '' END || CASE WHEN k % 11 = 10 THEN '' ELSE '}' END
    WHEN 2 THEN CASE WHEN k % 2 = 0 THEN '# pins' || chr(10) || 'Requests==2.25.' || CAST(k % 3 AS STRING) || chr(10)
             || 'urllib3>=1.' || CAST(k % 9 AS STRING) || chr(10) || 'numpy' || chr(10) || '-e .' || chr(10) || '# ' || plain || chr(10) ELSE 'print(f' || CAST(k AS STRING) || '(1, 2))' || chr(10) END
    WHEN 3 THEN '# ' || plain || chr(10) || CASE k % 3 WHEN 0 THEN '.env*' WHEN 1 THEN '.env' || chr(10) || '.env.local' ELSE 'dist' END
    WHEN 9 THEN 'import os' || chr(10) || 'import re, json' || chr(10) || 'def load(db, ids):' || chr(10) || '    for x in ids:' || chr(10)
             || CASE WHEN k % 2 = 0 THEN '        db.execute(x)' ELSE '        pass' END || chr(10) || '    return os.sep' || chr(10)
             || CASE WHEN k % 3 = 0 THEN 'load(None, [])' || chr(10) ELSE '' END || '# ' || plain || chr(10)
    WHEN 10 THEN 'CREATE TABLE t' || CAST(k AS STRING) || ' (id bigint, user_id bigint, org_id uuid);' || chr(10)
             || CASE WHEN k % 2 = 0 THEN 'CREATE INDEX ix ON t' || CAST(k AS STRING) || ' (user_id);' ELSE 'CREATE INDEX ix ON t' || CAST(k AS STRING) || ' (user_id, org_id);' END
             || chr(10) || '-- ' || plain || chr(10)
    WHEN 11 THEN 'const a = db.select(''*'')' || repeat(' ', CAST(k % 4 AS INT) * 80) || CASE WHEN k % 3 = 0 THEN '.order()' ELSE '.limit(5)' END || chr(10) || 'const b = fetch(url)' || chr(10)
             || '// ' || note || chr(10)
    WHEN 12 THEN '// demo' || chr(10) || 'const k = "sk-' || md5(CAST(doc_id AS STRING)) || '"' || chr(10) || 'const low = "sk-aaaaaaaaaaaaaaaaaaaaaaaa"' || chr(10)
             || '// ' || note || chr(10)
    WHEN 13 THEN 'const k = "sk-' || md5(CAST(doc_id AS STRING)) || '"' || chr(10)
             || '// ' || note || chr(10)
    WHEN 14 THEN 'def f' || CAST(k AS STRING) || '(a, b):' || chr(10) || '    c = a + b' || chr(10) || '    if c:' || chr(10) || '        c = c * ' || CAST(k AS STRING) || chr(10)
             || '    d = c' || chr(10) || CASE WHEN k % 5 = 0 THEN '    e = d' || chr(10) ELSE '' END || '    return d' || chr(10) || '# ' || plain || chr(10)
    WHEN 15 THEN 'function g' || CAST(k AS STRING) || '(a) {' || chr(10) || '  const b = "s' || CAST(k AS STRING) || '"; // n' || chr(10) || '  if (a) {' || chr(10) || '    return b;' || chr(10)
             || '  }' || chr(10) || CASE WHEN k % 7 = 0 THEN '  a += 1;' || chr(10) ELSE '' END || '  return a;' || chr(10) || '}' || chr(10) || '// ' || plain || chr(10)
    WHEN 16 THEN 'eval(x)' || chr(10)
             || '// ' || note || chr(10)
    WHEN 17 THEN 'x = eval(y)' || chr(10) || '# eval(z)' || chr(10) || 'r = get(u, verify=False)' || chr(10) || 'try: pass' || chr(10) || 'except: pass' || chr(10) || 'db.execute(f"select {x}")' || chr(10) || '# ' || plain || chr(10)
    WHEN 18 THEN 'import { createClient } from "@lib/db"' || chr(10) || 'export async function fetchUser(id) { return createClient() }' || chr(10) || 'const apiCall = async (x) => x' || chr(10)
             || '// ' || note || chr(10)
    WHEN 19 THEN 'region: eu' || chr(10) || text || chr(10)
    WHEN 6 THEN 'export function a' || CAST(k AS STRING) || '() {}' || chr(10) || 'export const b = 1' || chr(10)
             || '// ' || note || chr(10)
    WHEN 7 THEN 'import { a' || CAST(k - k % 2 AS STRING) || ', b as bb } from "./m6"' || chr(10) || 'export default function Page() {}' || chr(10)
             || '// ' || note || chr(10)
    WHEN 8 THEN 'export class C' || CAST(k AS STRING) || ' {}' || chr(10) || 'import Page from "./m7"' || chr(10)
             || '// ' || note || chr(10)
    ELSE text END AS content,
  1704067200 - (doc_id * 37 % 800) * 86400 AS mtime_epoch
FROM (SELECT doc_id, doc_id % 20 AS i, CAST(floor(doc_id / 20.0) AS BIGINT) AS k, coalesce(text, '') AS text,
  replace(coalesce(text, ''), chr(10), ' ') AS note,
  translate(coalesce(text, ''), PLAIN_SIGNS, '') AS plain FROM documents) d
""".replace("PLAIN_SIGNS", "chr(92) || '" + "".join(map(chr, range(1, 32))) + "\"''`{}();'")

# Texts in which every whole-text rule has hits and near misses: gaps go from just within a
# rule's reach to just beyond it.
RULES_SQL = """
SELECT 'r' || CAST(doc_id % 7 AS STRING) AS project, CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.js' END AS path,
  'for (const x of xs) {' || chr(10) || '  await db.find(x)' || chr(10) || '}' || chr(10)
  || 'for (const y of ys) {' || repeat(' ', gap + 480) || 'await db.select (y)' || chr(10)
  || 'list.forEach((t) => { supabase' || repeat(' ', gap + 85) || '.select(x) })' || chr(10)
  || 'while (a) {' || repeat(' ', gap + 190) || 'JSON.parse(y)' || chr(10)
  || 'async function f() {' || repeat('-', gap + 490) || 'existsSync(p)' || chr(10)
  || 'q.eq("status", 1).eq("colour", 2); a.sort().reverse(); b.sort( ); c.sort(x)' || chr(10)
  || 'for (i) {' || repeat(' ', gap + 190) || '+= "x"' || chr(10)
  || 'supabase.from(t).select(c)' || repeat(' ', gap + 140) || '.single()' || chr(10)
  || 'rows = cur.fetchall()' || repeat(' ', gap + 40) || 'LIMIT' || chr(10)
  || '// ' || note || chr(10) AS content
FROM (SELECT doc_id, CAST(doc_id % 20 AS INT) AS gap, replace(coalesce(text, ''), chr(10), ' ') AS note FROM documents) d
"""


def _key_lines() -> str:
    """For every key prefix a line with a key and one with a key that is one sign too short."""
    part = " || ".join(
        f"'a = \"{p}' || substr(md5(CAST(doc_id AS STRING)), 1, 10) || '\"' || chr(10) || "
        f"'b = \"{p}' || substr(md5(CAST(doc_id AS STRING)), 1, 9) || '\"' || chr(10)"
        for p, _ in PREFIXES
    )
    return f"{part} || coalesce(text, '')"


KEYS_SQL = f"""
SELECT 'k' || CAST(doc_id % 7 AS STRING) AS project, CASE WHEN doc_id % 4 = 0 THEN 'mock/' ELSE 'src/' END || CAST(doc_id AS STRING) AS path,
  {_key_lines()} AS content FROM documents
"""

# What the older versions of changed files begin with.
OLDER = "def older(x):\n    a = x\n    b = a\n    c = b\n    d = c\n    return d\n"

# The documents as files of directory trees: plain, nested, hidden and ignored paths.
TREE_SQL = """
SELECT replace(coalesce(source, 'none'), '/', '_') AS project,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.hidden/' WHEN 1 THEN 'a/b/c/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN 'a/_d/' ELSE '' END
    || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS path,
  coalesce(text, '') AS content
FROM documents
"""

# Files that searches stall or fail on, beside ones that hold the documents' texts. Most
# are built from a repeated head whose closing sign never comes.
HOSTILE_SQL = """
SELECT 'h' || CAST(CAST(floor(doc_id / 20.0) AS BIGINT) AS STRING) AS project, doc_id % 20 AS i, doc_id,
  CAST(doc_id AS STRING) || CASE CAST(doc_id % 20 AS INT) WHEN 2 THEN '.py' WHEN 5 THEN '.py' WHEN 6 THEN '.yaml' ELSE '.ts' END AS path,
  CASE CAST(doc_id % 20 AS INT)
    WHEN 0 THEN repeat('import { ', 12000) || note
    WHEN 1 THEN repeat('const a = (', 12000) || note
    WHEN 2 THEN repeat('-', 20000) || '1 # ' || note
    WHEN 3 THEN repeat('function f() {' || chr(10), 5000) || repeat('}', 5000) || chr(10) || '// ' || note
    WHEN 4 THEN CASE WHEN doc_id % 40 < 20 THEN '' ELSE NULL END
    WHEN 5 THEN 'key-1 ' || repeat('x', 100000) || chr(10) || '# ' || note
    ELSE '// ' || note || chr(10) || 'export const e' || CAST(doc_id AS STRING) || ' = "user-' || md5(CAST(doc_id AS STRING)) || '"' || chr(10) END AS content
FROM (SELECT doc_id, replace(translate(coalesce(text, ''), '{}()''"`', ''), chr(10), ' ') AS note FROM documents) d
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC: project = source, path = document number, content = text."""
    scan = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return files_from(spread_small(scan, "doc_id"), "source", "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGE: web pages as files of the project ``pages``."""
    scan = read(spark, sf_dir, "pages").select("page_id", "html")
    return files_from(spread_small(scan, "page_id"), F.lit("pages"), "page_id", "html")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CODE as a files table, with the project number ``k`` and template ``i`` kept."""
    scan = spread_small(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scan.createOrReplaceTempView("documents")
    rows = spark.sql(CODE_SQL)
    files = files_from(rows, "project", "path", "content", F.timestamp_seconds("mtime_epoch"))
    return files


def documents_in_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as files below a shared folder: the registry of their projects."""
    folder = f"{staging_dir(spark).removeprefix('file:')}/trees-{uuid.uuid4().hex}"
    read(spark, sf_dir, "documents").select("doc_id", "text", "source").createOrReplaceTempView("documents")
    files = spark.sql(TREE_SQL)
    write_tree(files, folder)
    return files.select(F.col("project").alias("name")).distinct().select(
        "name",
        F.concat(F.lit(f"{folder}/"), "name").alias("path"),
        F.array(F.lit("node_modules")).alias("ignore_patterns"),
    )


def written(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Files that ``sql`` writes from the documents."""
    scan = spread_small(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scan.createOrReplaceTempView("documents")
    return files_from(spark.sql(sql), "project", "path", "content")


def hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that stall or break a search, and harmless ones with the documents' texts.

    A file without content has a size, as one that could not be read.
    """
    files = written(spark, sf_dir, HOSTILE_SQL)
    return files.withColumn("size", F.coalesce("size", F.lit(1)))


def code_projects(files: DataFrame) -> DataFrame:
    """The registry of a derived corpus: every project, all languages, one ignore list."""
    return files.select(F.col("project").alias("name")).distinct().select(
        "name",
        F.lit(None).cast("string").alias("path"),
        F.array(*[F.lit(x) for x in ("python", "javascript", "typescript")]).alias("languages"),
        F.array(*[F.lit(x) for x in ("node_modules", ".git", "dist", "build")]).alias("ignore_patterns"),
    )


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF_EPOCH))
