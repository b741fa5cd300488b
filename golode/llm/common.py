"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders by application, for sessions that name no shared folder.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where
    the session names none and is local; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="golode-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


#: What this process wrote to shared folders.
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> None:
    """Deletes all tables and files that operators wrote so far. To be called once their results
    are no longer read, as these rest on them."""
    for path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()


#: Bytes of a row group of a staged table, which a task holds until it is full.
ROW_GROUP = 32 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and what was
    written survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that holds over 1 / HEAVY of all rows is joined by broadcast.
HEAVY = 256


def heavy_join(many: DataFrame, few: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """many joined with few, which has each key once and, in ``count``, how many of the ``rows`` rows
    of many hold it. Of keys that hold over rows / HEAVY there are fewer than HEAVY: these are
    broadcast, so no task gets all rows of one."""
    frequent = F.col(count) > rows / HEAVY
    heavy = F.broadcast(few.where(frequent))
    apart = many.join(heavy, key)
    return many.join(heavy.select(key), key, "left_anti").join(few.where(~frequent), key).unionByName(apart)


#: The most bits of a filter of keys, and bits for each key up to there.
FILTER_BITS, KEY_BITS = 1 << 25, 16


def maybe_in(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """rows whose key is in the column ``key`` of few, and some others: a Bloom filter of bounded size,
    broadcast, so that most rows without a partner are not shuffled. A join has to follow."""
    spark = rows.sparkSession
    bits = min(FILTER_BITS, 1 << max(12, (few.count() * KEY_BITS - 1).bit_length()))
    hashed = F.xxhash64(F.col(key).cast("long"))
    slots = [hashed.bitwiseAND(F.lit(bits - 1)), F.shiftright(hashed, 32).bitwiseAND(F.lit(bits - 1))]
    set_ = few.select(F.explode(F.array(*slots)).alias("slot")).selectExpr("shiftright(slot, 6) AS at", "shiftleft(1L, cast(slot & 63 AS int)) AS held")
    every = spark.range(bits >> 6).selectExpr("id AS at", "0L AS held")
    numbers = set_.unionByName(every).groupBy("at").agg(F.bit_or("held").alias("held"))
    name = free_name(rows, "filter")
    one = numbers.agg(F.sort_array(F.collect_list(F.struct("at", "held")))["held"].alias(name))

    def holds(slot):
        number = F.get(F.col(name), F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftright", number, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return rows.crossJoin(F.broadcast(one)).where(holds(slots[0]) & holds(slots[1])).drop(name)


#: Bytes that a process keeps of what it worked out for words or pieces of one operator.
KEPT_BYTES = 32 << 20
_OWNERS: list[Kept] = []


class Kept(dict):
    """Results by key, in two generations of half of KEPT_BYTES (``times`` as many) each: when the young
    one is full it becomes the old one, from which keys that are met again return; the others are
    forgotten. A process keeps those of one operator only: ``own`` empties the others."""

    #: Bytes of an entry beside its key and result: headers of both, and its share of the table.
    OVERHEAD = 200

    def __init__(self, make, times: int = 1):
        super().__init__()
        self.make, self.times, self.old, self.size = make, times, {}, 0
        #: What an operator keeps beside, in lists.
        self.lists = None
        _OWNERS.append(self)

    def own(self) -> None:
        for other in _OWNERS:
            if other is not self:
                other.forget()

    def forget(self) -> None:
        self.clear()
        self.old, self.size, self.lists = {}, 0, None

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.size += self.OVERHEAD + len(key) + (len(got) if isinstance(got, bytes) else 0)
        if self.size > self.times * KEPT_BYTES // 2:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = got
        return got


def portions(texts, most: int = 1_000_000):
    """Lists of texts in a row, each of about ``most`` characters at most (a longer text is alone)."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
