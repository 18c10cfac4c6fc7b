"""Unions by name with type promotion, and equi-joins on normalised keys with diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FractionalType, IntegralType, LongType, NumericType, StringType, TimestampNTZType, TimestampType

from sparkloom.functions.values import all_of, blank_trimmed, text
from sparkloom.plans.storage import materialise

TIMES = (TimestampType, TimestampNTZType, DateType)
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def promoted(kinds: Sequence[DataType]) -> DataType:
    """The type that holds all: boolean, then whole, then fractional numbers; any other mix is text."""
    if not kinds:
        return StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, (BooleanType, NumericType)) for k in kinds):
        return DoubleType() if any(isinstance(k, FractionalType) for k in kinds) else LongType()
    return StringType()


def _scrub(c: Column, kind: DataType) -> Column:
    return F.when(~blank_trimmed(c), c) if isinstance(kind, StringType) else c


def union(sets: Sequence[tuple[str, DataFrame]], source: str | None = "__source") -> DataFrame:
    """Rows of all named sets under the union of their columns, in the order of first appearance; blank texts become null."""
    if len(sets) < 2:
        raise ValueError("a union needs two datasets at least")
    names = list(dict.fromkeys(c for _, df in sets for c in df.columns))
    kinds = {c: promoted([df.schema[c].dataType for _, df in sets if c in df.columns]) for c in names}
    out = None
    for label, df in sets:
        cols = [(_scrub(text(F.col(c), df.schema[c].dataType) if isinstance(kinds[c], StringType) else F.col(c), df.schema[c].dataType).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names]
        one = df.select(*cols, *([F.lit(label).alias(source)] if source else []))
        out = one if out is None else out.union(one)
    return out


def source_counts(united: DataFrame, source: str = "__source") -> DataFrame:
    return united.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def _whole(digits: Column) -> Column:
    """Text of a whole number: no plus, no leading zeros, no minus zero."""
    return F.regexp_replace(F.regexp_replace(digits, r"^\+?(-?)0*(\d)", "$1$2"), r"^-0$", "0")


def join_key(c: Column, kind: DataType) -> Column:
    """One text for equal keys of any type: numbers and numeric texts (whole ones digit by digit), times to the millisecond and ISO texts; blank is null, which never matches."""
    moment = lambda t: F.concat(F.lit("d:"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    if isinstance(kind, TIMES):
        return moment(c)
    if isinstance(kind, IntegralType):
        return F.concat(F.lit("n:"), c.cast("string"))
    if isinstance(kind, DecimalType):
        digits = c.cast("string")
        return F.concat(F.lit("n:"), _whole(F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)))
    if isinstance(kind, NumericType):
        return F.concat(F.lit("n:"), text(c.cast("double"), DoubleType()))
    word = F.trim(c.cast("string"))
    as_whole = F.when(word.rlike(r"^[+-]?\d+(\.0+)?$"), F.concat(F.lit("n:"), _whole(F.regexp_replace(word, r"\..*$", ""))))
    as_number = F.when(word.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(F.lit("n:"), text(word.try_cast("double"), DoubleType())))
    as_number = F.coalesce(as_whole, as_number)
    as_date = F.when(word.rlike(r"^\d{4}-\d{2}-\d{2}([T ][0-9:.+-]+Z?)?$"), moment(word.try_cast("timestamp")))
    return F.when(word != "", F.coalesce(as_number, as_date, F.concat(F.lit("s:"), word)))


def _keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[list[Column], list[Column]]:
    """Keys to compare; whole numbers, fractional numbers and times of one type are compared as they are, so that bucketing and filters still reach the scan."""
    ls, rs = [], []
    for a, b in pairs:
        ka, kb = left.schema[a].dataType, right.schema[b].dataType
        plain = (isinstance(ka, IntegralType) and isinstance(kb, IntegralType)) or (ka == kb and isinstance(ka, (*TIMES, FractionalType)))
        ls.append(F.col(a) if plain else join_key(F.col(a), ka))
        rs.append(F.col(b) if plain else join_key(F.col(b), kb))
    return ls, rs


def join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner", short: str = "right") -> DataFrame:
    """Left columns, then right columns without its keys; a clash is named short__column; keys of right-only rows fill the left keys."""
    if how not in JOINS:
        raise ValueError(f"unknown join type: {how}")
    if not pairs:
        raise ValueError("a join needs a key pair at least")
    lk, rk = _keys(left, right, pairs)
    taken = set(left.columns)
    rkeys = [b for _, b in pairs]
    l = left.select(*[_scrub(F.col(c), left.schema[c].dataType).alias(f"__l_{c}") for c in left.columns], *[k.alias(f"__lk{i}") for i, k in enumerate(lk)])
    r = right.select(*[_scrub(F.col(c), right.schema[c].dataType).alias(f"__r_{c}") for c in right.columns], *[k.alias(f"__rk{i}") for i, k in enumerate(rk)])
    met = l.join(r, all_of([F.col(f"__lk{i}") == F.col(f"__rk{i}") for i in range(len(pairs))]), JOINS[how])
    back = dict(pairs)
    cols = []
    for c in left.columns:
        kind = left.schema[c].dataType
        fill = c in back and how in ("right", "full")
        cols.append((F.coalesce(f"__l_{c}", F.col(f"__r_{back[c]}").cast(kind)) if fill else F.col(f"__l_{c}")).alias(c))
    cols += [F.col(f"__r_{c}").alias(f"{short}__{c}" if c in taken else c) for c in right.columns if c not in rkeys]
    return met.select(*cols)


def diagnostics(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row about a join before it is made: rows, unmatched rows, rows of the inner join, and whether a key repeats on both sides.

    Both sides are first counted by key, so a key with a third of all rows is one row of the comparison.
    """
    lk, rk = _keys(left, right, pairs)
    names = [f"k{i}" for i in range(len(pairs))]

    def counted(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
        null = F.lit(False)
        for k in keys:
            null = null | k.isNull()
        held = df.select(null.alias("blank"), *[k.alias(n) for k, n in zip(keys, names)])
        return held.groupBy("blank", *names).agg(F.count(F.lit(1)).alias(name))

    a, b = counted(left, lk, "nl"), counted(right, rk, "nr")
    met = a.where("not blank").drop("blank").join(b.where("not blank").drop("blank"), names, "full")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    total = met.agg(
        F.coalesce(F.sum(nl * nr), F.lit(0)).alias("inner_rows"),
        F.coalesce(F.sum(F.when(nr == 0, nl)), F.lit(0)).alias("left_unmatched"),
        F.coalesce(F.sum(F.when(nl == 0, nr)), F.lit(0)).alias("right_unmatched"),
        F.coalesce(F.max((nl > 1) & (nr > 1)), F.lit(False)).alias("many_to_many"),
    )
    blanks = lambda df, n, out: df.where("blank").agg(F.coalesce(F.sum(n), F.lit(0)).alias(out))
    both = total.join(blanks(a, "nl", "bl")).join(blanks(b, "nr", "br"))
    return both.select("inner_rows", (F.col("left_unmatched") + F.col("bl")).alias("left_unmatched"), (F.col("right_unmatched") + F.col("br")).alias("right_unmatched"), "many_to_many")


def spread_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], by: str, how: str = "inner", parts: int = 32) -> DataFrame:
    """rows joined with keyed, which has one row for each key; a key that a third of the rows share is dealt to ``parts`` tasks.

    Rows are split by a hash of ``by``; keyed first goes to those (key, part) that occur, at most ``parts`` copies of a
    key, so neither join has a key with more rows than that. Null keys match nothing and are spread in the same way.
    """
    split = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)))
    there = split.select(*keys, "__part").distinct().join(keyed, list(keys))
    return split.join(there, [*keys, "__part"], how).drop("__part")


#: Rows that meet in a task about, and in a piece of a bucket at most; rows of a piece where both sides have more, and of one side at most.
PAIRS, PIECE, SIDE, LONG = 2**25, 2**22, 2**11, 2**16


def _pieces(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets with many pairs are dealt to a grid (__i, __j) of pieces, x to its rows, y to its columns; if there are many pairs, to as many tasks as they need.

    A bucket in the grid has at least 2 * SIDE rows, so the table of those, which is broadcast, has under a thousandth of the rows.
    """
    keys = ["__at", "__bucket"]
    counted = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    cells = materialise(counted(x, "nl").join(counted(y, "nr"), keys, "full").fillna(0, ["nl", "nr"]), "buckets")
    nl, nr = F.col("nl"), F.col("nr")
    total = cells.agg(F.sum(nl * nr)).first()[0] or 0

    def cuts(own: Column, other: Column) -> Column:
        """Cuts of a side: even pieces where both are long, else by the pairs."""
        by_pairs = F.when(own <= SIDE, F.lit(1)).when(other > SIDE, F.ceil(own / SIDE)).otherwise(F.ceil(own * other / PIECE))
        return F.greatest(by_pairs, F.ceil(own / LONG)).cast("long")

    heavy = F.broadcast(cells.where((nl * nr > PIECE) | (nl > LONG) | (nr > LONG)).select(*keys, cuts(nl, nr).alias("__p"), cuts(nr, nl).alias("__q")))
    parts = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        n, m = (F.coalesce(c, F.lit(1)) for c in (n_own, n_other))
        plain = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, StringType, BooleanType, *TIMES))]  # the same piece each time a task runs
        mine = F.pmod(F.xxhash64(*plain), n)
        rows = df.join(heavy, keys, "left").select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias(other))
        return rows.repartition(parts, *keys, "__i", "__j") if total > PAIRS else rows

    return dealt(x, "__i", "__p", "__j", "__q"), dealt(y, "__j", "__q", "__i", "__p")


def interval_join(left: DataFrame, right: DataFrame, ends: tuple[str, str], other: tuple[str, str], short: str = "right") -> DataFrame:
    """Pairs of a left row, from ends[0] to ends[1], and a right row, from other[0] to other[1], that overlap (touching counts); there is no equal key.

    An interval of length up to 2 ** k lies in one or two buckets of that width. It goes to those of its own k and of every larger k
    that occurs on the other side, so a pair meets at the larger k of the two, in the bucket where the later one of them begins, once. The
    rows that meet are those of one bucket: no nested loop, and no width that one long interval could spoil. Buckets are counted first, and those
    with many pairs are cut into pieces, so no task has more than its share of pairs however many there are. Points are intervals of length 0. Null ends and intervals that end before they begin meet nothing. A column that is in both is named short__column.

    ends are numbers, dates or timestamps (compared to the microsecond).
    """

    def bounds(df: DataFrame, names: tuple[str, str]) -> list[Column]:
        return [(F.unix_micros(F.col(c).cast("timestamp")) if isinstance(df.schema[c].dataType, TIMES) else F.col(c)).cast("double") for c in names]

    def level(lo: Column, hi: Column) -> Column:
        return F.when(hi > lo, F.ceil(F.log2(hi - lo)).cast("int"))

    def sized(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        lo, hi = bounds(df, names)
        return df.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi").withColumn("__k", level(F.col("__lo"), F.col("__hi")))

    a, b = sized(left, ends), sized(right, other)
    each = lambda df, side: df.select(F.lit(side).alias("side"), "__k")
    found = each(a, "l").union(each(b, "r")).where("__k is not null").distinct().collect()  # powers of two: some dozens
    least = min((k for _, k in found), default=0)

    def dealt(df: DataFrame, names: dict[str, str], others: str) -> DataFrame:
        own = F.coalesce("__k", F.lit(least))
        larger = F.array(*[F.lit(k) for k in sorted({k for side, k in found if side == others})]).cast("array<int>")
        ks = F.concat(F.array(own), F.filter(larger, lambda k: k > own))
        steps = lambda c: F.col(c) / F.pow(F.lit(2.0), F.col("__at"))
        floor = lambda x: x - F.pmod(x, F.lit(1.0))  # noqa: E731  as a double: no bucket number is too large
        rows = df.select(*[F.col(c).alias(n) for c, n in names.items()], "__lo", "__hi", own.alias("__own"), F.explode(ks).alias("__at"))
        first, last = floor(steps("__lo")), floor(steps("__hi"))
        return rows.withColumn("__bucket", F.explode(F.array_distinct(F.array(first, (first + last) / 2, last)))).where(F.col("__bucket") == floor(F.col("__bucket"))).withColumn("__first", first)

    names_l, names_r = {c: f"__l_{c}" for c in left.columns}, {c: f"__r_{c}" for c in right.columns}
    x = dealt(a, names_l, "r").withColumnsRenamed({"__lo": "__llo", "__hi": "__lhi", "__own": "__lown", "__first": "__lf"})
    y = dealt(b, names_r, "l").withColumnsRenamed({"__lo": "__rlo", "__hi": "__rhi", "__own": "__rown", "__first": "__rf"})
    x, y = _pieces(x, y)
    met = x.join(y, ["__at", "__bucket", "__i", "__j"]).where((F.col("__at") == F.greatest("__lown", "__rown")) & (F.col("__bucket") == F.greatest("__lf", "__rf")) & (F.col("__llo") <= F.col("__rhi")) & (F.col("__rlo") <= F.col("__lhi")))
    return met.select(*[F.col(n).alias(c) for c, n in names_l.items()], *[F.col(n).alias(f"{short}__{c}" if c in left.columns else c) for c, n in names_r.items()])


#: Keys with at least 1 / HOT of all weight are broadcast by ``weighed_join``; there are at most HOT of them.
HOT = 500


def weighed_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """rows joined with keyed, a written table with one row for each key and its weight (how many rows have it).

    Keys of at least 1 / HOT of all weight are at most HOT rows whatever the data, so they are broadcast; the others, none
    of which is hot, meet in a shuffle.
    """
    keys = list(keys)
    least = (keyed.agg(F.sum(weight)).first()[0] or 0) / HOT
    hot = F.broadcast(keyed.where(F.col(weight) >= least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(weight) < least), keys)
    return rows.join(hot, keys).select(*cold.columns).union(cold)
