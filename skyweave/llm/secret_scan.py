"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of secret is found by a regular expression; its spans follow from the lengths of what is skipped and matched.
Longer mixed tokens of no known kind are candidates too. The hash of each value is counted over the whole corpus by
distinct owner and repository (pre-aggregated by hash and owner, so that a value which everybody copies stays small):
values of few owners and repositories look live, the others are copied examples. Live candidates that do not overlap a
known span are added as kind `token`; spans of the known kinds always stay. Spans carry the hash of their value; what
is stored on the way holds places and hashes, never a value.

Cases: a null text has no spans; a null owner or repository counts as one owner or repository named null; repeated rows
get a result each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import stored

#: Fixed patterns of the kinds, in the order in which they are listed; letters of the assigned names in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = f"(?:{'|'.join(either_case(n) for n in NAMES)})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9_+/-]{20,}"
#: Least characters of an assigned value.
LEAST_VALUE = 8
#: A value of more owners, or more repositories, is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 5
KINDS = ("assign", "access", "hex", "token")
#: Matches in a block of a text.
FOLD = 256


def spans(text: Column, pattern: str, kind: int, value_group: int = 2, before: str = "") -> Column:
    """Array of (start, kind_no, end, value) of all matches, leftmost and not overlapping, in code points.

    Matches are added up in blocks of FOLD, so that a text of very many does not copy them for each one."""
    every = F.lit(rf"\G(?s:(.*?)){before}({pattern})")
    skipped, matched, value = (F.regexp_extract_all(text, every, F.lit(g)) for g in (1, 2, value_group))
    zipped = F.arrays_zip(skipped.alias("skipped"), matched.alias("matched"), value.alias("value"))
    element = "array<struct<start:bigint,kind_no:int,end:bigint,value:string>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["skipped"])
        end = start + F.length(x["matched"])
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    empty = F.array().cast(element)

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["found"], inner["found"]).alias("found"))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(zipped), F.lit(1)), F.lit(FOLD)), lambda k: F.slice(zipped, k, FOLD))
    state = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    return F.when(text.rlike(before + pattern), F.aggregate(blocks, state, block, lambda s: s["found"])).otherwise(empty)


def hashed(found: Column) -> Column:
    """(start, kind_no, end, hash): the values themselves go no further than the text."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))


def shown(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kind, x["kind_no"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, base, added, live, n_live, n_copied): arrays of spans, and how many known spans look live or copied.

    Where a table has no repositories a document stands for one, as in the default."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(spans(text, ASSIGN, 0, 3), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    mixed = F.filter(spans(text, TOKEN, 3, 2, "(?<![A-Za-z0-9_+/-])"), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), assigned.alias("assigned"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hex"), mixed.alias("mixed"))
    base = F.array_sort(hashed(F.concat("assigned", "access", "hex")))
    apart = F.filter(hashed(F.col("mixed")), lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = read.withColumn("base", base).select("doc_id", "owner", "repository", "base", apart.alias("candidates"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    values = found.select("row", "owner", "repository", F.explode(F.concat("base", "candidates")).alias("span"))
    values = values.select("row", "owner", "repository", "span", F.col("span.hash").alias("hash"))
    by_owner = values.groupBy("hash", "owner").agg(F.count_distinct(F.coalesce("repository", F.lit("null"))).alias("repositories"))
    frequency = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    judged = values.join(frequency, "hash").withColumn("live", live)
    known = F.col("span.kind_no") < 3
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("live"), F.col("span")))).alias("live"),
        F.count_if(known & F.col("live")).alias("n_live"),
        F.count_if(known & ~F.col("live")).alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,hash:string>>")
    return found.join(per_row, "row", "left").withColumn("live", F.coalesce("live", none)).select("doc_id", "base", F.filter("live", lambda x: x["kind_no"] == 3).alias("added"), "live", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or what of it lies behind the span before, replaced by the mask."""

    def step(state: Column, x: Column) -> Column:
        start = F.greatest(x["start"], state["at"])
        more = F.when(x["end"] > start, F.concat(F.substring(text, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int")), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.concat(state["out"], more).alias("out"))

    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, state, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
