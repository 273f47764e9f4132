"""Titles: the library, spellings of one title, names on other sites, articles, genres."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import DEFAULTS, MAIN_SITES, Settings
from titletide.functions import text as X
from titletide.functions.similarity import block_ratio, best_name_score
from titletide.operators.medians import top_k
from titletide.session import cut_lineage, stored
from titletide.sources import tables


# ---------------------------------------------------------------------------------------------
# library
# ---------------------------------------------------------------------------------------------


def build_library(fetched: DataFrame, cached: DataFrame, fallback: DataFrame,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """title, cacheable: the cleaned union of the sources; a failed source never shrinks it. ``cacheable`` is false
    when too few titles were fetched to rewrite the cache."""
    clean = lambda df: df.select(X.clean_title(F.col("title")).alias("title")).where("title IS NOT NULL").distinct()
    new = clean(fetched)
    enough = new.agg(F.count(F.lit(1)) >= settings.library_min_titles).scalar()
    whole = new.unionByName(clean(cached)).unionByName(fallback.select("title")).distinct()
    return whole.withColumn("cacheable", enough)


def exclude(df: DataFrame, keys: DataFrame, on: str = "title") -> DataFrame:
    """Rows whose key is not on the list."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without those of ``b``, counting repeats."""
    return a.exceptAll(b)


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels already written stay; only new headlines are added."""
    key = X.headline_key(F.col("headline"))
    known = old.select(key.alias("key")).distinct()
    fresh = new.withColumn("key", key).join(known, "key", "left_anti")
    columns = [c for c in new.columns]
    first = F.min(F.struct("headline", *[c for c in columns if c != "headline"])).alias("row")
    once = fresh.groupBy("key").agg(first).select("row.*").select(*columns)
    return old.withColumn("fresh", F.lit(False)).unionByName(once.withColumn("fresh", F.lit(True)))


def sibling_titles(catalogue: DataFrame, names: DataFrame) -> DataFrame:
    """title, name, sibling: library names that contain a title's name and are another title.

    ``catalogue``: title of the library; ``names``: title and search ``name`` looked for. A name is found inside
    longer ones by an equi join on their word runs, so no pair of titles is compared that does not share the name.
    """
    owners = F.transform(
        F.regexp_extract_all(F.col("title"), F.lit("([A-Za-z]+)['’]s\\b"), 1), lambda o: F.lower(F.concat(o, F.lit("s"))))
    library = catalogue.select(
        X.readable(F.col("title")).alias("other_title"), X.search_name(F.col("title")).alias("other"), owners.alias("owners")
    ).where("other <> ''").groupBy("other").agg(
        F.min("other_title").alias("other_title"), F.array_distinct(F.flatten(F.collect_set("owners"))).alias("owners"))
    words = F.split("other", " ", -1)
    starts = library.select("*", F.posexplode(words).alias("at", "_first"))
    runs = starts.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - F.col("at"))).alias("n")).select(
        "other", "other_title", "owners", "at", F.array_join(F.slice(words, F.col("at") + 1, F.col("n")), " ").alias("name"),
        F.slice(words, F.lit(1), F.col("at")).alias("before"),
        F.slice(words, F.col("at") + F.col("n") + 1, F.size(words)).alias("after"))
    first = runs.where("other <> name").groupBy("name", "other").agg(
        F.min_by(F.struct("other_title", "owners", "before", "after"), "at").alias("r")).select("name", "other", "r.*")
    lit = lambda ws: F.array(*[F.lit(w) for w in ws])
    found = names.select("title", "name").distinct().join(first, "name")
    extra = F.size(F.array_except("after", lit(vocab.EDITION_WORDS))) > 0
    owned = F.array_contains("owners", F.element_at("before", -1))
    brand = F.size(F.array_except("before", lit(vocab.BRAND_WORDS))) == 0
    prefixed = ~extra & (F.size("before") > 0) & ~owned & ~brand
    full = (
        extra & (F.size("before") == 0)
        & F.startswith(F.lower("other_title"), F.concat(F.lower(X.readable(F.col("title"))), F.lit(":")))
        & (F.size(F.array_intersect("after", lit(vocab.EXPANSION_WORDS))) == 0)
        & ~F.coalesce(F.try_element_at("after", F.lit(1)).rlike("^[0-9]+$"), F.lit(False))
    )
    judged = found.where(extra | prefixed).withColumn("full", full)
    # One full name alone is the title itself under its long name.
    lone = judged.where("full").groupBy("title", "name").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("only"))
    own = lone.where("n = 1").select("title", "name", F.col("only").alias("other"))
    return judged.join(own, ["title", "name", "other"], "left_anti").select("title", "name", F.col("other").alias("sibling"))


def rename(names: DataFrame, rules: DataFrame) -> DataFrame:
    """name, site, renamed: the first rule of a site whose words start the name, applied to its start.

    ``rules``: site, position (own rules before borrowed ones), old, new. The join is on the name's own leading
    runs, so rules are looked up and never scanned.
    """
    words = F.split("name", " ", -1)
    heads = names.select("name").distinct().select("name", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("old"))
    hits = heads.join(rules, "old")
    picked = hits.groupBy("name", "site").agg(F.min_by(F.struct("old", "new"), "position").alias("r"))
    return picked.select("name", "site", F.concat("r.new", F.expr("substring(name, length(r.old) + 1)")).alias("renamed"))


def skip_renamed(pairs: DataFrame, renamed: DataFrame) -> DataFrame:
    """(name, site) pairs without those whose name is another title's name on that site."""
    taken = renamed.select(F.col("renamed").alias("name"), "site").distinct()
    own = renamed.select("name", "site").distinct()
    return pairs.join(taken.join(own, ["name", "site"], "left_anti"), ["name", "site"], "left_anti")


def pin_aliases(mentioned: DataFrame, pinned: DataFrame) -> DataFrame:
    """key, target: a mentioned key, or the pinned title whose search words or name it is. ``mentioned``: key, name;
    ``pinned``: key, search_words, search."""
    words = pinned.select(F.col("search_words").alias("said"), F.col("key").alias("by_words"))
    names = pinned.select(F.col("search").alias("name"), F.col("key").alias("by_name"))
    rows = mentioned.join(words, mentioned["key"] == words["said"], "left").join(names, "name", "left")
    return rows.select(mentioned["key"], F.coalesce("by_words", "by_name", mentioned["key"]).alias("target")).distinct()


def add_titles(tracked: DataFrame, extra: DataFrame, library: DataFrame, level: str) -> DataFrame:
    """Extra titles that are in the library and not tracked yet, by key and by name, and can be searched for.
    All sides: title."""
    keyed = lambda df: df.withColumn("key", X.key_of(F.col("title"))).withColumn("name", X.search_name(F.col("title")))
    known = keyed(tracked)
    own = keyed(library).groupBy("key").agg(F.min_by(F.struct("title", "name"), "title").alias("own"))
    wanted = (
        keyed(extra).select("key").distinct()
        .join(own, "key")
        .select("key", "own.*")
        .join(known.select("key").distinct(), "key", "left_anti")
        .join(known.select("name").distinct(), "name", "left_anti")
    )
    safe = F.col("name").contains(" ") | F.col("name").isin(*vocab.ONE_WORD_TITLES)
    short = F.length("name") + 4 <= 100
    once = wanted.where(safe & short).groupBy("name").agg(F.min(F.struct("key", "title")).alias("t"))
    return once.select("t.title", "t.key", "name", F.lit(level).alias("level"))


def resolve_keys(names: DataFrame, library: DataFrame, never: DataFrame) -> DataFrame:
    """name, title: the library title of each collection name, without the titles never to be priced."""
    by_name = library.withColumn("name", X.search_name(F.col("title"))).groupBy("name").agg(F.min("title").alias("title"))
    barred = never.select(X.key_of(F.col("title")).alias("key")).distinct()
    return (
        names.select("name").distinct().join(by_name, "name")
        .withColumn("key", X.key_of(F.col("title")))
        .join(barred, "key", "left_anti")
        .select("name", "title")
    )


def place_listed(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """list, rank, title, placed, matched: the tracked title of each listed entry, by its search on the list's site,
    by its name there, then by its general name; an entry of its own otherwise. Editions (with required words) are
    never the plain title. ``entries``: list, rank, site, title, search, require; ``titles``: title, name, site, search."""
    local = titles.groupBy("site", F.col("search").alias("said")).agg(F.min("title").alias("hit"))
    general = titles.groupBy("name").agg(F.min("title").alias("by_general"))
    rows = entries.withColumn("name", X.search_name(F.col("title")))
    plain = F.size(F.coalesce("require", F.array().cast("array<string>"))) == 0
    joined = (
        rows.join(local.select("site", F.col("said").alias("search"), F.col("hit").alias("by_search")), ["site", "search"], "left")
        .join(local.select("site", F.col("said").alias("name"), F.col("hit").alias("by_name")), ["site", "name"], "left")
        .join(general, "name", "left")
    )
    hit = F.when(plain, F.coalesce("by_search", "by_name", "by_general"))
    return joined.select("list", "rank", "title", F.coalesce(hit, F.col("title")).alias("placed"),
                         hit.isNotNull().alias("matched"))


def listed_sites(entries: DataFrame, extra: dict[str, tuple[str, ...]], settings: Settings = DEFAULTS) -> DataFrame:
    """search, site: where each listed identity is looked up: its lists' sites, and for the first ranks the extra ones."""
    more = F.lit(None).cast("array<string>")
    for name, sites in extra.items():
        more = F.when((F.col("list") == name) & (F.col("rank") <= settings.rare_extra_top),
                      F.array(*[F.lit(s) for s in sites])).otherwise(more)
    sites = F.concat(F.array("site"), F.coalesce(more, F.array().cast("array<string>")))
    return entries.select("search", F.explode(sites).alias("site")).distinct()


# ---------------------------------------------------------------------------------------------
# spellings of one title
# ---------------------------------------------------------------------------------------------


def spelling_edges(titles: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """a, b: each spelling tied to the first of every key it shares (a star, never all pairs). ``titles``: key, file;
    ``same``: hand-made a, b."""
    free = titles.where(~F.col("key").isin(*vocab.KEEP_APART)).select(
        "key",
        F.explode(F.array(
            F.concat(F.lit("l:"), X.loose_key(F.col("key"))),
            F.concat(F.lit("c:"), X.compact(F.col("key"))),
            F.concat(F.lit("f:"), F.col("file"), F.lit("#"), F.array_join(X.numbers_in(X.unpadded(F.col("key"))), "#")),
        )).alias("shared"),
    ).where("shared IS NOT NULL")
    hubs = free.groupBy("shared").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = free.join(hubs, "shared").select(F.col("key").alias("a"), "b")
    if same is not None:
        edges = edges.unionByName(same.select("a", "b"))
    return edges.where("a <> b").distinct()


def _stars(held: int | None = None, roots: bool = False):
    """Edges a, b as edges from each node to the smallest node it reaches through the edges of this task, taken up to
    ``held`` nodes at a time; with ``roots`` the smallest nodes too, as edges to themselves."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(node):
            while up[node] != node:
                up[node] = up[up[node]]
                node = up[node]
            return node

        def out(schema: pa.Schema) -> pa.RecordBatch:
            nodes = [n for n in up if roots or up[n] != n]
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, schema.field(0).type), pa.array([root(n) for n in nodes], schema.field(1).type)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
                if held and len(up) >= held:
                    yield out(schema)
                    up.clear()
        if up:
            yield out(schema)
    return stars


def components(nodes: DataFrame, edges: DataFrame, held: int = 200_000, small: int = 16 << 20) -> DataFrame:
    """key, root: connected components, each named by its smallest key.

    Tasks first turn their edges into stars, ``held`` nodes at a time, which takes paths out and shuffles nothing. Every
    round then hooks each node to its smallest neighbour. Only two nodes can point at each other, and the smaller of them
    is a root, so every tree has two nodes at least. Pointers jump until the trees are flat, and the edges between
    different roots, as stars again, are the graph of the next round, with at most half its nodes: rounds grow with the
    logarithm of a component's size, jumps with that of a tree's depth. A graph whose edges, counted anew each round, take
    at most ``small`` bytes is finished by one task; the answer is the same for any ``held`` and ``small``. Rounds are cut
    by written tables: a checkpoint keeps the constraints of its plan, which multiply with every join of a table with itself.
    Tables of nodes grow with the input, so none is sent whole to the driver or a task: they are merged.
    """
    known = stored(nodes.where("key IS NOT NULL").select("key").distinct())
    inside = edges.select("a", "b").where("a <> b").join(known.withColumnRenamed("key", "a").hint("merge"), "a", "left_semi").join(
        known.withColumnRenamed("key", "b").hint("merge"), "b", "left_semi").select("a", "b")
    starred = lambda graph: stored(graph.mapInArrow(_stars(held), graph.schema), "components")
    width = F.octet_length(F.col("a").cast("string")) + F.octet_length(F.col("b").cast("string")) + 32
    open_ = starred(inside)
    rounds: list[DataFrame] = []
    while size := open_.agg(F.sum(width)).first()[0]:
        if size <= small:
            rounds.append(stored(open_.coalesce(1).mapInArrow(_stars(roots=True), open_.schema).toDF("key", "up"), "components"))
            break
        both = stored(open_.union(open_.select("b", "a")).distinct(), "components")
        hooks = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("up")))
        above = lambda tree: tree.select(F.col("key").alias("up"), F.col("up").alias("above")).hint("merge")
        is_root = (F.col("above") == F.col("key")) & (F.col("key") < F.col("up"))
        tree = stored(hooks.join(above(hooks), "up").select(
            "key", F.when(is_root, F.col("key")).otherwise(F.col("up")).alias("up")), "components")
        moved = 1
        while moved:
            jumped = stored(tree.join(above(tree), "up").select(
                "key", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")), "components")
            moved = jumped.agg(F.count_if("moved")).first()[0]
            tree = jumped.select("key", "up")
        rounds.append(tree)
        left, right = (tree.select(F.col("key").alias(n), F.col("up").alias(f"{n}_root")).hint("merge") for n in ("a", "b"))
        open_ = starred(open_.join(left, "a").join(right, "b").where("a_root <> b_root").select(
            F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    if not rounds:
        return known.withColumn("root", F.col("key"))
    found = rounds.pop()
    while rounds:  # roots of a round are nodes of the next, unless their component is whole
        later = found.select(F.col("key").alias("up"), F.col("up").alias("last")).hint("merge")
        found = stored(rounds.pop().join(later, "up", "left").select("key", F.coalesce("last", "up").alias("up")), "components")
    named = found.join(found.groupBy("up").agg(F.min("key").alias("root")).hint("merge"), "up").select("key", "root")
    return known.join(named.hint("merge"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def title_groups(titles: DataFrame, same: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """key, shown: for every spelling that is not shown itself, the spelling its group is shown under.

    ``titles``: key, official, file (the shared file's key, may be NULL). Shown is the spelling whose rarest word is
    most used, official ones first, then the one closest to the file's name, then the shortest.
    """
    found = components(titles, spelling_edges(titles, same))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    members = cut_lineage(titles.join(found.join(sizes, "root"), "key"))
    words = titles.select("key", F.explode(F.array_distinct(F.split("key", " ", -1))).alias("word"))
    used = words.groupBy("word").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("uses"))
    rarest = words.join(used, "word").groupBy("key").agg(F.min("uses").alias("rarest"))
    file = members.where("file IS NOT NULL").groupBy("root").agg(F.min_by("file", "key").alias("group_file"))
    scored = (
        members.join(rarest, "key")
        .join(file, "root", "left")
        .withColumn("near", block_ratio(F.col("key"), F.coalesce("group_file", F.lit(""))))
    )
    best = F.max_by("key", F.struct("rarest", "official", "near", -F.length("key"), "key")).alias("shown")
    groups = members.select("root", "key").join(scored.groupBy("root").agg(best), "root").where("key <> shown")
    out = groups.select("key", "shown")
    if apart is not None:
        pairs = apart.select("a", "b").union(apart.select("b", "a")).toDF("key", "shown")
        out = out.join(pairs, ["key", "shown"], "left_anti")
    return out


def audit_verdict(settings: Settings = DEFAULTS) -> Column:
    """flagged when a merged spelling lists clearly more copies than its keeper on a site."""
    own, keeper = F.col("copies"), F.col("keeper_copies")
    more = (own >= keeper + settings.audit_more_copies) & (own >= keeper * settings.audit_more_ratio)
    silent = F.coalesce("unmatched", F.lit(False)) | own.isNull() | keeper.isNull()
    return F.when(silent, "no figure").when(more, "FLAGGED").otherwise("agrees")


def audit_spellings(merged: DataFrame, looks: DataFrame, latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """spelling, keeper, site, copies, median, keeper_copies, keeper_median, verdict of every merged spelling's look.
    ``merged``: spelling, keeper; ``looks`` and ``latest``: title, site, copies, median, unmatched."""
    own = looks.where(F.col("site").isin(*MAIN_SITES)).select(
        F.col("title").alias("spelling"), "site", "copies", "median", "unmatched")
    theirs = latest.select(F.col("title").alias("keeper"), "site", F.col("copies").alias("keeper_copies"),
                           F.col("median").alias("keeper_median"))
    rows = merged.join(own, "spelling").join(theirs, ["keeper", "site"], "left")
    return rows.withColumn("verdict", audit_verdict(settings)).select(
        "spelling", "keeper", "site", "copies", "median", "keeper_copies", "keeper_median", "verdict")


def merge_spellings(titles: DataFrame, latest: DataFrame, groups: DataFrame,
                    audit: DataFrame | None = None) -> DataFrame:
    """title, keeper, outcome (kept, dropped, apart), mentions and level after the merge.

    ``titles``: title, level, pinned, special, mentions; ``latest``: title, site, copies; ``groups``: title, root.
    A group keeps the spelling with most copies on the main sites; another is dropped only when it is free and lists
    no more than the keeper on either. Sites are two, so a title's copies fit one row.
    """
    copies = latest.where(F.col("site").isin(*MAIN_SITES)).groupBy("title").agg(
        *[F.max(F.when(F.col("site") == s, F.col("copies"))).alias(f"on_{s}") for s in MAIN_SITES],
        F.lit(True).alias("known"))
    rows = titles.join(copies, "title", "left").join(groups, "title", "left").withColumn(
        "root", F.coalesce("root", F.concat(F.lit("own:"), F.col("title"))))
    for s in MAIN_SITES:
        rows = rows.withColumn(f"on_{s}", F.coalesce(f"on_{s}", F.lit(0)))
    total = sum((F.col(f"on_{s}") for s in MAIN_SITES), F.lit(0))
    open_ = ~F.col("special") & (F.col("level") != "surging") & F.coalesce("known", F.lit(False))
    order = F.struct("pinned", total.alias("total"), -F.length("title"), "title")
    keeper = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("members"),
        F.max_by(F.struct("title", *[f"on_{s}" for s in MAIN_SITES]), F.when(open_, order)).alias("k"))
    flagged = (F.lit(None).cast("boolean") if audit is None else F.col("flagged"))
    joined = rows.join(keeper, "root")
    if audit is not None:
        bad = audit.where("verdict = 'FLAGGED'").select(F.col("spelling").alias("title"), F.lit(True).alias("flagged")).distinct()
        joined = joined.join(bad, "title", "left")
    fixed = F.col("special") | F.col("pinned") | ~F.col("level").isin("normal", "staple", "dormant")
    larger = F.lit(False)
    for s in MAIN_SITES:
        larger = larger | (F.col(f"on_{s}") > F.col(f"k.on_{s}"))
    outcome = (
        F.when(F.col("members") == 1, "kept")
        .when(F.col("k").isNull(), "apart")
        .when(F.col("title") == F.col("k.title"), "kept")
        .when(fixed | larger | F.coalesce(flagged, F.lit(False)), "apart")
        .otherwise("dropped")
    )
    judged = joined.withColumn("outcome", outcome).withColumn("keeper", F.when(F.col("outcome") == "dropped", F.col("k.title")))
    passed = judged.where("outcome = 'dropped'").groupBy(F.col("keeper").alias("title")).agg(
        F.sum("mentions").alias("more"), F.bool_or(F.col("level") != "dormant").alias("faster"))
    final = judged.join(passed, "title", "left")
    level = F.when((F.col("level") == "dormant") & F.coalesce("faster", F.lit(False)), "normal").otherwise(F.col("level"))
    return final.select("title", "keeper", "outcome", level.alias("level"),
                        (F.col("mentions") + F.coalesce("more", F.lit(0))).alias("mentions"))


# ---------------------------------------------------------------------------------------------
# looking names up
# ---------------------------------------------------------------------------------------------


def close_pairs(keys: DataFrame, spellings: DataFrame, cutoff: float) -> DataFrame:
    """key, spelling of every pair that can reach ``cutoff`` (similarity 2 x common / total length), and few others.

    A pair that close is at most ``d`` edits apart, so when a spelling is cut into ``d + 1`` pieces one of them
    stands unharmed in the key, near its own place. Pieces are joined by equality: no group is paired with itself
    and no pair is missed.
    """
    slack = 2 / cutoff - 1  # longest key a spelling of length 1 can be close to
    edits = lambda n: F.floor(F.lit(1 - cutoff) * (1 + slack) * n + 1e-9).cast("int")
    numbers = lambda c: F.array_join(X.numbers_in(F.col(c)), ",")
    start = F.floor(F.col("i") * F.col("n") / (F.col("d") + 1)).cast("int")
    width = F.floor((F.col("i") + 1) * F.col("n") / (F.col("d") + 1)).cast("int") - start

    pieces = (
        spellings.select("spelling").distinct()
        .withColumn("numbers", numbers("spelling"))
        .withColumn("n", F.length("spelling"))
        .withColumn("d", edits(F.col("n")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .select("spelling", "numbers", "n", "i", F.substr("spelling", start + 1, width).alias("piece"))
    )
    probes = (
        keys.select("key").distinct()
        .withColumn("numbers", numbers("key"))
        .withColumn("m", F.length("key"))
        .withColumn("n", F.explode(F.sequence(
            F.ceil(F.col("m") / slack).cast("int"), F.floor(F.col("m") * slack).cast("int"))))
        .withColumn("d", edits(F.col("n")))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .withColumn("start", start)
        .withColumn("width", width)
        .withColumn("at", F.explode(F.sequence(F.col("start") - F.col("d"), F.col("start") + F.col("d"))))
        .where((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("m")))
        .select("key", "numbers", "n", "i", F.substr("key", F.col("at") + 1, F.col("width")).alias("piece"))
        .distinct()
    )
    return probes.join(pieces, ["numbers", "n", "i", "piece"]).where("key <> spelling").select("key", "spelling").distinct()


def typo_match(keys: DataFrame, spellings: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """key, spelling, score: the closest spelling with the same numbers and no differing word of one or two letters."""
    # Matching blocks are a common subsequence, so the ratio bounds the edit distance, which the JVM tests first.
    room = F.floor((1 - cutoff) * (F.length("key") + F.length("spelling")) + 1e-9).cast("int")
    near = F.call_function("levenshtein", F.col("key"), F.col("spelling"), room) >= 0
    pairs = close_pairs(keys, spellings, cutoff).where(near)
    scored = pairs.withColumn("score", block_ratio(F.col("key"), F.col("spelling"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("key").agg(F.max_by(F.struct("spelling", "score"), F.struct("score", "spelling")).alias("m"))
    words = lambda c: F.split(c, " ", -1)
    differ = F.array_union(F.array_except(words(F.col("key")), words(F.col("m.spelling"))),
                           F.array_except(words(F.col("m.spelling")), words(F.col("key"))))
    small = F.exists(differ, lambda w: (F.length(w) <= 2) & ~w.isin(*vocab.SHORT_TYPO_WORDS))
    return best.where(~small).select("key", "m.spelling", "m.score")


def alias_cascade(names: DataFrame, known: DataFrame, manual: DataFrame | None = None, rounds: int = 30) -> DataFrame:
    """key, target, how: names the collection spells differently, found by hand list, same letters, unpadded numbers,
    loose key, a unique longer name, then a typo. Names found can be targets in the next round, until a round finds none.
    ``names``, ``known``: key."""
    left = names.select("key").distinct().join(known.select("key"), "key", "left_anti")
    base = known.select("key", F.col("key").alias("target")).distinct()
    found = None
    typos = typo_match(left, known.select(X.unpadded(F.col("key")).alias("spelling")))
    for _ in range(rounds):
        pick = lambda df, how: df.groupBy("by").agg(F.min("target").alias(how))
        compacted = pick(base.withColumn("by", X.compact(F.col("key"))), "compact")
        plain = pick(base.withColumn("by", X.unpadded(F.col("key"))), "plain")
        loose = pick(base.withColumn("by", X.loose_key(F.col("key"))), "loose")
        words = F.split("key", " ", -1)
        heads = base.where(F.size(words) > 1).select("target", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("by"))
        longer = heads.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("longer")).where("n = 1").drop("n")
        rows = left.withColumn("c", X.compact(F.col("key"))).withColumn("l", X.loose_key(F.col("key")))
        rows = (
            rows.join(compacted, rows["c"] == compacted["by"], "left").drop("by")
            .join(plain, rows["key"] == plain["by"], "left").drop("by")
            .join(loose, rows["l"] == loose["by"], "left").drop("by")
            .join(longer, rows["key"] == longer["by"], "left").drop("by")
            .join(typos.select("key", "spelling"), "key", "left")
            .join(plain.select(F.col("by").alias("spelling"), F.col("plain").alias("typo")), "spelling", "left")
        )
        by_hand = F.lit(None).cast("string")
        if manual is not None:
            rows = rows.join(manual.select("key", F.col("target").alias("manual")), "key", "left")
            by_hand = F.col("manual")
        target = F.coalesce(by_hand, "compact", "plain", "loose", "longer", "typo")
        how = (F.when(by_hand.isNotNull(), "manual").when(F.col("compact").isNotNull(), "compact")
               .when(F.col("plain").isNotNull(), "plain").when(F.col("loose").isNotNull(), "loose")
               .when(F.col("longer").isNotNull(), "longer").when(F.col("typo").isNotNull(), "typo"))
        step = cut_lineage(rows.select("key", target.alias("target"), how.alias("how")).where("target IS NOT NULL"))
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            return found
        base = base.unionByName(step.select("key", "target"))
        left = left.join(step.select("key"), "key", "left_anti")
    raise RuntimeError("aliases did not settle; raise the number of rounds")


def resolve_articles(candidates: DataFrame, threshold: int = 82) -> DataFrame:
    """title, article, score: the candidate whose bare name is most like the title, if it is like enough.
    ``candidates``: title, article, position."""
    lowered = F.lower("article")
    bad = F.lit(False)
    for hint in vocab.BAD_ARTICLE_HINTS:
        bad = bad | lowered.contains(hint)
    bare = F.split_part("article", F.lit(" ("), F.lit(1))
    scored = candidates.where(~bad).withColumn("score", best_name_score(F.col("title"), bare))
    best = scored.groupBy("title").agg(F.max_by(F.struct("article", "score"), F.struct("score", -F.col("position"))).alias("b"))
    return best.select("title", "b.article", "b.score").where(F.col("score") >= threshold)


def audited_merge(path: str, titles: DataFrame, groups: DataFrame, figures: DataFrame, looks: DataFrame,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """R9: one run of the audit loop, which reads the verdicts of the run before from the table at ``path`` and leaves its
    own there. A spelling that was flagged is not merged again, so a merge that turns out to lose copies undoes itself; its
    verdict is kept, as a spelling that stands for itself is looked at no more. ``figures``: what is merged by; ``looks``:
    the merged spellings' own figures and the keepers'. Returns the merge."""
    shape = titles.sparkSession.createDataFrame(
        [], "spelling STRING, keeper STRING, site STRING, copies BIGINT, median DOUBLE, keeper_copies BIGINT, keeper_median DOUBLE, verdict STRING")
    before = tables.published(titles.sparkSession, path, shape)
    merged = merge_spellings(titles, figures, groups, before)
    dropped = merged.where("outcome = 'dropped'").select(F.col("title").alias("spelling"), "keeper")
    found = audit_spellings(dropped, looks, looks, settings).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.schema))
    flagged = before.where("verdict = 'FLAGGED'").join(dropped, "spelling", "left_anti").select(*shape.columns)
    tables.publish(found.unionByName(flagged), path)
    return merged


def majority(votes: DataFrame, value: str = "genre", order: str = "position") -> DataFrame:
    """key and the value most votes name; of equals the one seen first. ``votes``: key, value, order."""
    counts = votes.groupBy("key", value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy("key").agg(
        F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("v")).select("key", f"v.{value}", "v.n")


def genres(votes: DataFrame, library: DataFrame) -> DataFrame:
    """key, genre, how: the majority of the records' genre buckets, else a keyword of the name."""
    voted = majority(votes.withColumn("genre", X.genre_bucket(F.col("genre"))))
    rows = library.select("key").distinct().join(voted, "key", "full_outer")
    guess = X.keyword_genre(F.col("key"))
    return rows.select("key", F.coalesce("genre", guess).alias("genre"),
                       F.when(F.col("genre").isNotNull(), "voted").otherwise("word").alias("how")).where("genre IS NOT NULL")


def best_releases(files: DataFrame) -> DataFrame:
    """key, title, us, pal: the spelling with most files, and its best American and European release. ``files``: name."""
    suffix = F.regexp_extract("name", r"^(.*?)((?:\s*\([^)]*\))+)$", 2)
    title = F.when(suffix != "", F.trim(F.regexp_extract("name", r"^(.*?)((?:\s*\([^)]*\))+)$", 1))).otherwise(F.col("name"))
    plain = F.replace(F.replace(title, F.lit(" _ "), F.lit(" and ")), F.lit("_"), F.lit(" "))
    rows = files.select(title.alias("title"), suffix.alias("suffix"), X.search_name(plain).alias("key")).where("key <> ''")
    tag = F.trim(F.split_part(F.regexp_extract("suffix", r"^\s*\(([^)]*)\)", 1), F.lit(","), F.lit(1)))

    def order(tags: tuple[str, ...]) -> Column:
        place = F.coalesce(*[F.when(tag == t, F.lit(i)) for i, t in enumerate(tags)], F.lit(len(tags)))
        return F.struct(F.col("suffix").rlike(vocab.RELEASE_JUNK), place, F.length("suffix"), F.col("suffix"))

    usable = lambda c: F.when(~c.rlike(vocab.RELEASE_JUNK) & F.startswith(F.trim(c), F.lit("(")), c)
    per_title = rows.groupBy("key", "title").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("suffix", order(vocab.US_RELEASE_TAGS)).alias("us"),
        F.min_by("suffix", order(vocab.PAL_RELEASE_TAGS)).alias("pal"))
    pick = F.max_by(F.struct("title", "us", "pal"), F.struct("n", -F.length("title"), "title")).alias("b")
    best = per_title.groupBy("key").agg(pick).select("key", "b.*")
    return best.withColumn("us", usable(F.col("us"))).withColumn("pal", usable(F.col("pal"))).where(
        "us IS NOT NULL OR pal IS NOT NULL")


def quota_sample(rows: DataFrame, n: int, seed: int, per_title: int = vocab.SAMPLE_MAX_PER_TITLE) -> DataFrame:
    """About ``n`` rows: each bucket's share, topped up from what is left; a title fills at most ``per_title`` rows.

    ``rows``: headline, titles. Draws are ranks of a seeded hash, so titles and buckets are trimmed to the rows that can
    be drawn before anything is gathered.
    """
    key = X.headline_key(F.col("headline"))
    first = F.min(F.struct("headline", "titles", "source")).alias("r")
    once = rows.where(F.length("headline") >= vocab.SAMPLE_MIN_CHARS).groupBy(key.alias("key")).agg(first).where(
        "key <> ''").select("key", "r.*")
    draw = F.xxhash64("key", F.lit(seed))
    named = F.filter(F.array_distinct("titles"), lambda t: t.isNotNull())
    once = once.withColumn("draw", draw).withColumn("named", F.coalesce(F.size(named), F.lit(0)))
    pairs = once.select("key", "draw", F.explode(named).alias("t"))
    within = top_k(pairs, ["t"], [F.col("draw"), F.col("key")], per_title).groupBy("key").agg(F.count(F.lit(1)).alias("fit"))
    pool = once.join(within, "key", "left").where((F.col("named") == 0) | (F.col("named") == F.col("fit"))).withColumn(
        "bucket", X.sample_bucket(F.col("headline"), F.col("titles")))
    quota = F.lit(0)
    for bucket, share in vocab.SAMPLE_QUOTAS.items():
        quota = F.when(F.col("bucket") == bucket, round(n * share)).otherwise(quota)
    near = top_k(pool, ["bucket"], [F.col("draw"), F.col("key")], n).withColumn("extra", F.col("rank") > quota)
    return near.orderBy("extra", "draw", "key").limit(n).select("headline", "source", "bucket", "titles")
