"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: numbers, units and names turn into typed placeholders, all else is lower-cased without outer
punctuation. Windows of ``WINDOW`` tokens of the documents meet those of the benchmark in a hash join, so a question whose
numbers or names were changed still matches. The values behind the placeholders decide: numbers and units may change from place
to place, but a name of the benchmark must stand for one name of the document throughout. Of several names, that of most windows
counts, and windows with others do not. Windows that are mostly placeholders, and items too short for windows, are compared word
for word. ``SQL`` has neither of these two, nor the least numbers of matched windows: it gives the same rows where no benchmark
window is dense and every item has four windows or more.

DataFrame functions only. A first pass canonicalises whole texts by regular expressions and hashes their windows; documents that
hold enough windows of an item, whatever the slots, are read once more with their slots. The benchmark's windows are broadcast
while there are at most ``BROADCAST`` of them; beyond that the same joins shuffle. The texts of the first pass do not move: only
matches are grouped, by document and item, and a group holds at most as many windows as the two share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Tokens of a window that are no placeholders, at least.
LITERALS = 3
#: Share of an item's windows that a document holds if it is contaminated.
COVERAGE = 0.5
#: Matched windows, at least, for an item that has as many: 6 words in a row.
FEWEST = 2
#: Matched windows, at least, where only those count that are not dense in placeholders.
FEWEST_TEMPLATES = 3
#: Items of fewer words are also looked for as a whole; those of fewer than ``ALONE`` as whole documents only.
SMALL = 8
ALONE = 3
#: Benchmark windows (two numbers and a few words each) that may be broadcast.
BROADCAST = 200_000
# Units of measure
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l dl s sec secs min mins h hr hrs day days week weeks month months year years second seconds minute minutes hour hours meter meters metre metres mile miles inch inches foot feet gram grams liter liters litre litres dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh w kw kwh v a hz khz mhz ghz kb mb gb tb j n pa"
STOPS = (".", "!", "?", ":")
OUTER = ".,;:!?()[]{}\"'"
PLACEHOLDERS = ("<num>", "<unit>", "<name>")
CAPITAL = r"[\p{Lu}\p{Lt}]"
_OUTER = r"[.,;:!?()\[\]{}\"']"


def _words(text: str) -> Column:
    space = " \t\n\x0b\f\r"
    inner = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(space))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _ends(words: Column, i: Column) -> Column:
    """Whether the word before ends a sentence, or there is none."""
    return (i == 0) | F.substring(F.get(words, i - 1), -1, 1).isin(*STOPS)


def _name(bare: Column, i: Column) -> Column:
    """A capital letter within a sentence; words without any are told first."""
    low = F.get("low", i)
    return F.when(bare == low, low).when(bare.rlike(f"^{CAPITAL}") & ~_ends(F.col("words"), i), "<name>").otherwise(low)


def _token(bare: Column, i: Column) -> Column:
    """As :func:`_name` for texts that hold digits."""
    unit = F.get("low", i).isin(*UNITS.split()) & (i > 0)
    return F.when(F.get("words", i).rlike("[0-9]"), "<num>").when(unit & F.get("words", i - 1).rlike("[0-9]"), "<unit>").otherwise(_name(bare, i))


def _staged(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The words of each text, without outer punctuation (``bare``) and lower-cased (``low``)."""
    staged = table.select(F.col(key), _words(text).alias("words"), F.col(text).rlike("[0-9]").alias("digits"))
    return staged.withColumn("bare", F.transform("words", lambda w: F.trim(w, F.lit(OUTER)))).withColumn("low", F.transform("bare", lambda b: F.lower(b)))


def canonical(text: str = "text") -> Column:
    """The tokens of a text joined by single blanks, as :func:`windows` makes them word by word; empty for texts without words."""
    space = " \t\n\x0b\f\r"
    plain = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(space)), r"[\x20\x09-\x0D]+", " ")
    # a unit behind a number keeps the punctuation around it, which tells whether a sentence ends
    unit = rf"((?<![^ ])[^ 0-9]*+[0-9][^ ]*+ {_OUTER}*+)(?i:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))})(?={_OUTER}*+(?![^ ]))"
    name = rf"(?<=[^ .!?:] )({_OUTER}*+){CAPITAL}[^ 0-9]*+(?![^ ])"
    digits = F.col(text).rlike("[0-9]")
    out = F.regexp_replace(F.when(digits, F.regexp_replace(plain, unit, "$1<unit>")).otherwise(plain), name, "$1<name>")
    out = F.when(digits, F.regexp_replace(out, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<num>")).otherwise(out)
    return F.lower(F.regexp_replace(out, rf"(?<![^ ]){_OUTER}++|(?<!{_OUTER}){_OUTER}++(?![^ ])", ""))


def _window(column: str, i: Column, size: int) -> Column:
    """Hash of ``size`` entries of an array column from place ``i`` on, counted from 0; compiled, without slices."""
    return F.xxhash64(*(F.get(column, i + k) for k in range(size)))


def hashes(table: DataFrame, key: str, text: str = "text", size: int = WINDOW, exact: bool = False) -> DataFrame:
    """(key, hash): the hashes of :func:`windows`, without their slots."""
    space = " \t\n\x0b\f\r"
    columns = [F.col(key), F.split(canonical(text), " ").alias("tokens")]
    if exact:
        columns.append(F.transform(F.split(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(space)), r"[\x20\x09-\x0D]+"), lambda w: F.lower(F.trim(w, F.lit(OUTER)))).alias("low"))
    # places are told from the size behind the explode, and that is an outer one: a filter before it, one's own or the one that is
    # inferred from an inner explode, would canonicalise twice
    each = table.select(*columns).select("*", F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("pos") + (size - 1) < F.size("tokens"))
    hashed = _window("tokens", F.col("pos"), size)
    if exact:
        marks = sum((F.get("tokens", F.col("pos") + k).isin(*PLACEHOLDERS).cast("int") for k in range(size)), F.lit(0))
        hashed = F.when(marks > WINDOW - LITERALS, F.xxhash64(F.lit("="), *(F.get("low", F.col("pos") + k) for k in range(size)))).otherwise(hashed)
    return each.select(key, hashed.alias("hash"))


def windows(table: DataFrame, key: str, text: str = "text", size: int = WINDOW, exact: bool = False) -> DataFrame:
    """(key, pos, hash, slots, names): every window of canonical tokens; slots: the words behind placeholders, null elsewhere; names:
    those behind names only.

    With ``exact``, a window of more than ``WINDOW - LITERALS`` placeholders, whose template says little, has the hash of its
    lower-cased words instead, and no names to compare.
    """
    staged = (
        _staged(table, key, text)
        .where(F.size("words") >= size)
        .withColumn("tokens", F.when(F.col("digits"), F.transform("bare", _token)).otherwise(F.transform("bare", _name)))
        .withColumn("values", F.zip_with("bare", "tokens", lambda b, t: F.when(t.isin(*PLACEHOLDERS), b)))
        .withColumn("named", F.zip_with("bare", "tokens", lambda b, t: F.when(t == "<name>", b)))
    )

    def hashed(i: Column) -> Column:
        template = _window("tokens", i - 1, size)
        return F.when(_dense(F.slice("values", i, size)), F.xxhash64(F.lit("="), *(F.get("low", i - 1 + k) for k in range(size)))).otherwise(template) if exact else template

    none = F.array().cast("array<string>")
    each = F.transform(
        F.sequence(F.lit(1), F.size("tokens") - (size - 1)),
        lambda i: F.struct(
            hashed(i).alias("hash"),
            i.alias("pos"),
            F.slice("values", i, size).alias("slots"),
            F.when(_dense(F.slice("values", i, size)), none).otherwise(F.array_compact(F.slice("named", i, size))).alias("names"),
        ),
    )
    return staged.select(key, F.explode(each).alias("w")).select(key, "w.pos", "w.hash", "w.slots", "w.names")


def _dense(slots: Column) -> Column:
    return F.size(F.array_compact(slots)) > WINDOW - LITERALS


def _small(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, size, hash) of items of fewer than ``SMALL`` words, and their sizes."""
    items = _staged(benchmark.where("item_id is not null"), "item_id").select("item_id", "low", F.size("low").alias("size")).where(F.col("size").between(1, SMALL - 1))
    items = items.select("item_id", "size", F.xxhash64("low").alias("hash")).distinct()
    return items, sorted(r["size"] for r in items.select("size").distinct().collect())


def _whole(docs: DataFrame, items: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """(row, item_id) for small items that the document holds word for word."""
    staged = _staged(docs, "row")

    def runs(n: int) -> DataFrame:
        held = staged.where(F.size("low") == n if n < ALONE else F.size("low") >= n)
        each = F.transform(F.sequence(F.lit(1), F.size("low") - (n - 1)), lambda i: F.xxhash64(F.slice("low", i, n)))
        return held.select("row", F.explode(each).alias("hash"), F.lit(n).alias("size"))

    every = runs(sizes[0])
    for n in sizes[1:]:
        every = every.union(runs(n))
    hint = "broadcast" if items.limit(most + 1).count() <= most else "merge"
    return every.join(items.hint(hint), ["size", "hash"]).select("row", "item_id").distinct()


def _held(coverage: float, matched: str, alike: str) -> Column:
    """Whether so many windows of an item, and so many that are not dense, make a document hold it."""
    share = (F.col(matched) >= coverage * F.col("n_windows")) & (F.col(matched) >= F.least(F.lit(FEWEST), "n_windows"))
    return share | ((F.col(alike) >= coverage * F.col("n_templates")) & (F.col(alike) >= FEWEST_TEMPLATES))


def identified(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): ``row`` is the id where ids are unique and none is null, else a key of its own, written with the text."""
    from ._base import write

    own = docs.select("doc_id", "text")
    doubt = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    return write(own.withColumn("row", F.monotonically_increasing_id()), "keyed") if doubt else own.withColumn("row", F.col("doc_id"))


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, most: int) -> DataFrame:
    """(row, item_id, n_windows, n_matched, n_slots, verbatim) for ``docs`` (row, text), ``row`` unique."""
    from ._base import write

    own = windows(benchmark.where("item_id is not null"), "item_id", exact=True).withColumn("item_slots", F.array_compact("slots"))
    items = own.select("item_id", F.col("pos").alias("item_pos"), "hash", "item_slots", F.col("names").alias("item_names"), _dense(F.col("slots")).alias("dense")).distinct()
    total = items.groupBy("item_id").agg(F.count_distinct("hash").alias("n_windows"), F.count_distinct(F.when(~F.col("dense"), F.col("hash"))).alias("n_templates"))
    fits = items.limit(most + 1).count() <= most
    exact = bool(items.where("dense").limit(1).count())  # documents hash words only where an item needs it
    hint = "broadcast" if fits else "merge"

    met = hashes(docs, "row", exact=exact).join(items.select("hash").distinct().hint(hint), "hash").distinct()
    likely = met.join(items.select("item_id", "hash", "dense").distinct().hint(hint), "hash").groupBy("row", "item_id")
    likely = likely.agg(F.count("*").alias("n_matched"), F.count_if(~F.col("dense")).alias("n_alike")).join(total.hint(hint), "item_id")
    likely = write(likely.where(_held(coverage, "n_matched", "n_alike")).select("row", "item_id"), "likely")

    # written: filters on the words would move below the join and look at all texts
    again = write(docs.join(likely.select("row").distinct(), "row", "left_semi"), "again")
    found = windows(again, "row", exact=exact).join(items.hint(hint), "hash").join(likely, ["row", "item_id"])
    found = found.withColumn("slots", F.array_compact("slots")).where((F.size("slots") == F.size("item_slots")) & (F.size("names") == F.size("item_names")))
    zipped = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("v")))
    found = write(found.select("row", "item_id", "hash", F.when(~F.col("dense"), F.col("hash")).alias("template"), zipped("item_slots", "slots").alias("pairs"), zipped("item_names", "names").alias("names")), "found")
    bound = found.select("row", "item_id", F.inline("names")).groupBy("row", "item_id", "a", "v").agg(F.count("*").alias("c"))
    best = bound.groupBy("row", "item_id", "a").agg(F.min(F.struct((-F.col("c")).alias("c"), "v")).alias("b"))
    best = best.groupBy("row", "item_id").agg(F.collect_list(F.struct("a", "b.v")).alias("best"))
    fine = found.join(best, ["row", "item_id"], "left").where(F.forall("names", lambda p: F.array_contains("best", p)) | (F.size("names") == 0))
    pair = fine.groupBy("row", "item_id").agg(
        F.count_distinct("hash").alias("n_matched"),
        F.count_distinct("template").alias("n_alike"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("pairs", lambda p: p["a"]))))).cast("long").alias("n_slots"),
        F.every(F.forall("pairs", lambda p: p["a"] == p["v"])).alias("verbatim"),
    )
    pairs = pair.join(total.hint(hint), "item_id").where(_held(coverage, "n_matched", "n_alike")).select("row", "item_id", "n_windows", "n_matched", "n_slots", "verbatim")
    small, sizes = _small(benchmark)
    if not sizes:
        return pairs
    rest = _whole(docs, small, sizes, most).join(pairs.select("row", "item_id"), ["row", "item_id"], "left_anti").join(total.select("item_id", "n_windows").hint(hint), "item_id", "left")
    n = F.coalesce("n_windows", F.lit(1).cast("long"))
    return pairs.unionByName(rest.select("row", "item_id", n.alias("n_windows"), n.alias("n_matched"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("verbatim")))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, most: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, verbatim) for each pair in which the document holds the item.

    ``n_windows`` counts the distinct windows of the item, ``n_matched`` those found with consistent names, ``n_slots`` the
    benchmark values rebound there; ``verbatim``: no value differs. Windows dense in placeholders match word for word, in
    any case. An item is held if a share ``coverage`` of all its windows is matched, and ``FEWEST`` of them if it has as many; or
    that share of its windows that are not dense, and ``FEWEST_TEMPLATES`` of them, so that changed values still match. Items
    of fewer than ``SMALL`` words are also found as a whole, word for word, those of fewer than ``ALONE`` only where the
    document is nothing else: one window if they have none, ``n_slots`` 0.

    Every row is a document of its own, whatever its id: repeated rows and rows with a null doc_id give rows of their own. Null
    and empty texts hold nothing; texts of any length are searched whole; benchmark rows with a null item_id match nothing, and
    repeated ones count once; other columns are ignored; an empty table on either side gives no rows.
    """
    rows = identified(docs)
    found = _found(rows.select("row", "text"), benchmark, coverage, most)
    return rows.select("row", "doc_id").join(found, "row").select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "verbatim")


def drop_held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, each by a key of its own, whatever its ``doc_id``; all columns stay."""
    from ._base import write

    keyed = write(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    gone = write(_found(keyed.select(F.col("__row").alias("row"), "text"), benchmark, COVERAGE, BROADCAST).select(F.col("row").alias("__row")).distinct(), "contaminated")
    return keyed.join(gone.hint("shuffle_hash"), "__row", "left_anti").select(docs.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same."""
    return drop_held(docs, benchmark)


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """:func:`contaminated` with production parameters."""
    return contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


_CANONICAL = """
@name_words AS (
  SELECT @key, @id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT @key, @id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws FROM @table)
  WHERE len(ws) >= %d
), @name_before AS (
  SELECT *, trim(w, '%s') AS bare, lag(w) OVER (PARTITION BY @key ORDER BY pos) AS before FROM @name_words
), @name_tokens AS (
  SELECT *, CASE WHEN regexp_matches(w, '[0-9]') THEN '<num>'
    WHEN lower(bare) IN (%s) AND regexp_matches(coalesce(before, ''), '[0-9]') THEN '<unit>'
    WHEN regexp_matches(bare, '^[\\p{Lu}\\p{Lt}]') AND before IS NOT NULL AND right(before, 1) NOT IN ('.', '!', '?', ':') THEN '<name>'
    ELSE lower(bare) END AS token FROM @name_before
), @name_slots AS (
  SELECT *, CASE WHEN token IN ('<num>', '<unit>', '<name>') THEN bare END AS slot, CASE WHEN token = '<name>' THEN bare END AS named FROM @name_tokens
), @name_windows AS (
  SELECT @key, @id, pos, to_json(list(token) OVER o) AS template, list_filter(list(slot) OVER o, lambda x: x IS NOT NULL) AS slots, list_filter(list(named) OVER o, lambda x: x IS NOT NULL) AS names, count(*) OVER o AS n
  FROM @name_slots WINDOW o AS (PARTITION BY @key ORDER BY pos ROWS BETWEEN CURRENT ROW AND %d FOLLOWING)
), @name AS (
  SELECT * FROM @name_windows WHERE n = %d AND len(slots) <= %d
)""" % (WINDOW, OUTER.replace("'", "''"), ", ".join(f"'{u}'" for u in UNITS.split()), WINDOW - 1, WINDOW, WINDOW - LITERALS)


def _canonical(name: str, key: str, id_: str, table: str) -> str:
    return _CANONICAL.replace("@name", name).replace("@key", key).replace("@id", id_).replace("@table", table)


SQL = (
    f"WITH {_canonical('d', 'row', 'doc_id', '(SELECT row_number() OVER () AS row, doc_id, text FROM documents)')}, "
    + _canonical("b", "item_id", "1 AS one", "(SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)").replace("1 AS one, unnest", "unnest").replace("item_id, 1 AS one, pos", "item_id, pos")
    + """, met AS (
  SELECT row, doc_id, item_id, d.pos AS pos, b.pos AS item_pos, template, d.slots, b.slots AS item_slots, d.names, b.names AS item_names FROM d JOIN b USING (template)
), bound AS (
  SELECT row, item_id, pos, item_pos, unnest(item_names) AS a, unnest(names) AS v FROM met
), ranked AS (
  SELECT row, item_id, a, v, row_number() OVER (PARTITION BY row, item_id, a ORDER BY count(*) DESC, v) AS place FROM bound GROUP BY row, item_id, a, v
), clash AS (
  SELECT DISTINCT row, item_id, pos, item_pos FROM bound JOIN ranked USING (row, item_id, a, v) WHERE place > 1
), fine AS (
  SELECT * FROM met ANTI JOIN clash USING (row, item_id, pos, item_pos)
), pair AS (
  SELECT row, any_value(doc_id) AS doc_id, item_id, count(DISTINCT template) AS n_matched FROM fine GROUP BY row, item_id
), value AS (
  SELECT row, item_id, count(DISTINCT a) AS n_slots, bool_and(a = v) AS verbatim FROM (SELECT row, item_id, unnest(item_slots) AS a, unnest(slots) AS v FROM fine) GROUP BY ALL
), total AS (
  SELECT item_id, count(DISTINCT template) AS n_windows FROM b GROUP BY ALL
)
SELECT doc_id, item_id, n_windows, n_matched, coalesce(n_slots, 0) AS n_slots, coalesce(verbatim, true) AS verbatim
FROM pair JOIN total USING (item_id) LEFT JOIN value USING (row, item_id) WHERE n_matched >= 0.5 * n_windows
"""
)
