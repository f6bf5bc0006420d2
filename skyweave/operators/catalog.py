"""Catalogs and class labels. Labels are arrays inside and pipe-separated strings at the edges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import numbered

ARCSEC = 3600.0
NONE = "NONE"


def keep_targets(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Catalog rows of each sector's targets; targets has (ID, sector)."""
    return catalog.join(targets.select("ID", "sector").distinct(), "ID")


def coverage(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Targets and those found in the catalog, per sector."""
    there = catalog.select("ID").distinct().withColumn("there", F.lit(1))
    return targets.join(there, "ID", "left").groupBy("sector").agg(F.count("*").alias("targets"), F.count("there").alias("found"))


def without_series(targets: DataFrame, lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """Targets with no series (or not done yet)."""
    return targets.join(lc.select(key).distinct(), key, "left_anti")


def haversine(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Separation in degrees."""
    a1, d1, a2, d2 = (F.radians(x) for x in (ra1, dec1, ra2, dec2))
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin((a2 - a1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def _cells(table: DataFrame, size: float, around: bool) -> DataFrame:
    """Declination bands of `size` degrees and steps of right ascension that are at least as wide on the sky."""
    band = F.floor((F.col("dec") + 90) / size)
    out = table.withColumn("band", F.explode(F.sequence(band - 1, band + 1))) if around else table.withColumn("band", band)
    # the widest latitude of a band, seen from both sides, decides how many steps go round it
    edge = F.least(F.greatest(F.abs(F.col("band") * size - 90), F.abs((F.col("band") + 1) * size - 90)) + size, F.lit(90.0))
    steps = F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / size), F.lit(1))
    out = out.withColumn("steps", steps)
    step = F.floor(F.pmod(F.col("ra"), F.lit(360.0)) / 360.0 * F.col("steps"))
    if not around:
        return out.withColumn("cell", step).drop("steps")
    near = F.array_distinct(F.transform(F.sequence(step - 1, step + 1), lambda x: F.pmod(x, F.col("steps"))))
    return out.withColumn("cell", F.explode(near)).drop("steps")


def sky_match(targets: DataFrame, sources: DataFrame, tol_arcsec: float, size: float | None = None) -> DataFrame:
    """I4: the nearest source within the tolerance for each target (ID, ra, dec), NULL where there is none.

    An equi-join on cells of the sky, each target looking into its own cell and those around; sources are
    (source_id, ra, dec), not beyond `size` degrees a cell. Rows at one place are one place there: places meet, each with
    the least source_id at it, and what they find goes back to the targets by place."""
    size = max(size or 0.0, tol_arcsec / ARCSEC * 1.01, 1e-3)
    left = _cells(targets.select("ra", "dec").distinct(), size, True)
    right = _cells(sources.groupBy("ra", "dec").agg(F.min("source_id").alias("source_id")), size, False).select("source_id", F.col("ra").alias("s_ra"), F.col("dec").alias("s_dec"), "band", "cell")
    found = left.join(right, ["band", "cell"]).withColumn("sep", haversine(F.col("ra"), F.col("dec"), F.col("s_ra"), F.col("s_dec")) * ARCSEC).filter(F.col("sep") < tol_arcsec)
    nearest = F.min_by("source_id", F.struct("sep", "source_id")).alias("source_id"), F.min("sep").alias("sep")
    placed = targets.select("ID", "ra", "dec").join(found.groupBy("ra", "dec").agg(*nearest), ["ra", "dec"])
    best = placed.groupBy("ID").agg(*nearest).withColumnRenamed("sep", "sep_arcsec")  # an ID may stand at several places
    return targets.select("ID").join(best, "ID", "left")


def match_counts(matches: DataFrame, tolerances: list[float]) -> DataFrame:
    """How many matches lie within each tolerance."""
    row = matches.agg(*(F.count_if(F.col("sep_arcsec") < t).alias(f"n{i}") for i, t in enumerate(tolerances)))
    cells = F.array(*(F.struct(F.lit(float(t)).alias("tol"), F.col(f"n{i}").alias("n")) for i, t in enumerate(tolerances)))
    return row.select(F.inline(cells))


def magnitude_pairs(matches: DataFrame, catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """Both magnitudes of each match."""
    return matches.filter("source_id is not null").join(catalog.select("ID", "Tmag"), "ID").join(sources.select("source_id", "magMax"), "source_id").select("ID", "source_id", "Tmag", "magMax")


def id_match(targets: DataFrame, other: DataFrame, key: str = "ID") -> DataFrame:
    """I6."""
    return targets.join(other, key, "left")


def first_alternate(targets: DataFrame, ids: list[str], known: DataFrame) -> DataFrame:
    """The first hit through a chain of alternate ids; known has (alt_id, main_id)."""
    chain = F.array(*(F.struct(F.lit(i).alias("priority"), F.col(c).cast("string").alias("alt_id")) for i, c in enumerate(ids)))
    rows = targets.select("ID", F.inline(chain)).filter("alt_id is not null")
    best = rows.join(known, "alt_id").groupBy("ID").agg(F.min_by("main_id", F.struct("priority", "main_id")).alias("main_id"), F.min("priority").alias("priority"))
    return targets.select("ID").join(best, "ID", "left")


def cone(catalog: DataFrame, ra: float, dec: float, radius: float, faintest: float) -> DataFrame:
    """I8: objects within a radius (degrees) and brighter than a limit; the band of declination is pushed to the scan."""
    band = catalog.filter(F.col("dec").between(dec - radius, dec + radius) & (F.col("Tmag") < faintest))
    sep = haversine(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec))
    return band.withColumn("sep", sep).filter(F.col("sep") <= radius)


def sexagesimal(text: Column, hours: bool) -> Column:
    """`d m s` or `d:m:s` to degrees; hours count 15."""
    part = F.split(F.trim(text), "[ :]+")
    size = F.abs(part[0].cast("double")) + part[1].cast("double") / 60 + part[2].cast("double") / 3600
    return F.when(F.trim(text).startswith("-"), -size).otherwise(size) * (15 if hours else 1)


def as_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")


def parse_labels(text: Column, rename: dict[str, str], unwanted: list[str]) -> Column:
    """Array of sorted distinct labels."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), "[+/]", "|"), r"\|")
    clean = F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "[:?*]+$", ""))
    named = F.transform(clean, lambda x: F.coalesce(F.try_element_at(as_map(rename), x), x)) if rename else clean
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: (x != "") & ~x.isin(unwanted) if unwanted else x != "")))


def rename_labels(text: Column, rename: dict[str, str]) -> Column:
    """Labels of one vocabulary in another, order kept."""
    return F.array_join(F.transform(F.split(text, r"\|"), lambda x: F.coalesce(F.try_element_at(as_map(rename), x), x)), "|")


def to_parents(labels: Column, parents: dict[str, str]) -> Column:
    """Children become their parents, each once; a parent that is beside a child of its own then (one that is a parent
    itself) goes; nothing becomes NONE."""
    up = F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(as_map(parents), x), x))))
    for parent in dict.fromkeys(parents.values()):
        own = F.array(*(F.lit(c) for c, p in parents.items() if p == parent))
        up = F.when(F.array_contains(up, parent) & F.arrays_overlap(up, own), F.array_remove(up, parent)).otherwise(up)
    return F.when(F.size(up) == 0, F.array(F.lit(NONE))).otherwise(up)


def to_parents_by(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """I12 with the classes as a table (child, parent); rows has (id, labels array)."""
    each = rows.select("id", F.explode("labels").alias("child"))
    up = each.join(parents, "child", "left").select("id", F.coalesce("parent", "child").alias("label")).distinct()
    beside = up.join(parents.withColumnRenamed("child", "label"), "label").select("id", F.col("parent").alias("label")).distinct()
    kept = up.join(beside, ["id", "label"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return rows.select("id").distinct().join(kept, "id", "left").select("id", F.coalesce("labels", F.array(F.lit(NONE))).alias("labels"))


def merge_labels(labels: Column, same: dict[str, str], redundant: dict[str, list[str]]) -> Column:
    """Classes are merged, then those made redundant by another one go."""
    merged = F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(as_map(same), x), x)))
    for keep, drop in redundant.items():
        merged = F.when(F.array_contains(merged, keep), F.array_except(merged, F.array(*map(F.lit, drop)))).otherwise(merged)
    return F.array_sort(F.array_remove(merged, ""))


def truth_of(tables: list[DataFrame]) -> DataFrame:
    """(id, otype); a later table replaces an earlier one."""
    out = None
    for i, t in enumerate(tables):
        rows = t.select("id", "otype", F.lit(i).alias("priority"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("id").agg(F.max_by("otype", F.struct("priority", "otype")).alias("otype"))


def merge_rows(rows: DataFrame, useless: list[str]) -> DataFrame:
    """The union of an object's labels, sorted and joined."""
    every = F.array_distinct(F.flatten(F.collect_list(F.split("otype", r"\|"))))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.array_except(every, F.array(*map(F.lit, ["", *useless])))), "|").alias("otype"))


def truth_lookup(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """I16: missing becomes '', blank becomes NONE; of repeated ids the least (priority, otype) wins."""
    first = labels.groupBy("id").agg(F.min_by("otype", F.struct("priority", "otype")).alias("otype"))
    got = F.when(F.col("found").isNull(), "").when(F.trim("otype") == "", NONE).otherwise(F.col("otype"))
    return targets.select("id").join(first.withColumn("found", F.lit(1)), "id", "left").select("id", got.alias("otype"))


def override(labels: DataFrame, special: DataFrame, tag: str = "Pec") -> DataFrame:
    """The tag goes from all labels; special (id, special) objects get theirs."""
    plain = F.array_join(F.array_remove(F.split("otype", r"\|"), tag), "|")
    return labels.join(special, "id", "left").select("id", F.coalesce("special", plain).alias("otype"))


def number_labels(labels: DataFrame) -> DataFrame:
    """Labels numbered in sorted order."""
    numbers = numbered(labels.select("otype").distinct(), "otype").select("otype", F.col("number").cast("int").alias("number"))
    return labels.join(numbers, "otype").select("id", "otype", "number")


def having_class(labels: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """By substring, as usual there, or by whole labels."""
    return labels.filter(F.array_contains(F.split("otype", r"\|"), name) if whole else F.col("otype").contains(name))


def clean_labels(rows: DataFrame, unwanted: list[str]) -> DataFrame:
    """Blanks, spaces, flags and listed classes go; rows left empty go too."""
    parts = F.transform(F.split("otype", r"[|+/]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s", ""), "[:?*]+$", ""))
    kept = F.array_except(F.array_distinct(parts), F.array(*map(F.lit, ["", *unwanted])))
    return rows.withColumn("otype", F.array_join(kept, "|")).filter("otype <> ''")


def families(labels: DataFrame, family_of: DataFrame) -> DataFrame:
    """(id, family) for each family among an object's labels; none: other; no label: not classified."""
    rows = labels.select("id", F.explode(F.split("otype", r"\|")).alias("type")).filter("type <> ''")
    hits = rows.join(F.broadcast(family_of), "type").select("id", "family").distinct()
    rest = labels.select("id", "otype").join(hits.select("id").distinct(), "id", "left_anti")
    return hits.unionByName(rest.select("id", F.when(F.coalesce("otype", F.lit("")).isin("", NONE), "not classified").otherwise("other").alias("family")))


def family_counts(labels: DataFrame, family_of: DataFrame) -> DataFrame:
    return families(labels, family_of).groupBy("family").agg(F.count_distinct("id").alias("objects"))


def budget(labels: DataFrame, descriptions: DataFrame, top: int = 5) -> DataFrame:
    """Objects by label with its description; labels beyond the top ones are `rest`."""
    counts = labels.groupBy("otype").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "otype").limit(top).select("otype", F.col("otype").alias("group"))  # `top` rows
    return counts.join(descriptions, "otype", "left").join(F.broadcast(first), "otype", "left").withColumn("group", F.coalesce("group", F.lit("rest")))


def together(tables: list[DataFrame]) -> DataFrame:
    """I23."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
