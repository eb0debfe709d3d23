"""Secret scans with corpus-wide ownership frequency, with built-in Spark functions only.

Every candidate value (the values of base spans, and bare random-looking strings) is hashed and counted over the whole
corpus by distinct repositories and owners. A value that COPIED_OWNERS owners hold in as many repositories is a widely copied
example. Of the others, since documents are copied now and then, those that look like a credential may be live: they get a
span of kind live. Texts are read once: candidates are written to the shared folder with hashes in the values' place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import saved, skewed_left_join
from textquarry.llm.spans import HIDDEN, as_spans, found, joined, let, masked

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "live"]

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Shorter runs fail anyway and hide nothing, since a match takes its run to the end.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Bare strings of one run of any length that may be keys; digits, capitals and small letters must all occur. Looked for with
#: base spans hidden; what touches one is no run of its own.
BARE = rf"(?<![A-Za-z0-9+/_={HIDDEN}-])[A-Za-z0-9+/_-]{{20,}}+={{0,2}}+(?![A-Za-z0-9+/_={HIDDEN}-])"

#: Owners, and repositories, from which on a value is a copied example.
COPIED_OWNERS = 3
#: Distinct characters that a bare value, and the value of a base span, has at least if it looks like a credential.
BARE_CHARACTERS, VALUE_CHARACTERS = 10, 6
#: Parts of values that stand for a credential to be filled in.
PLACEHOLDERS = r"(?i)example|placeholder|change_?me|your[_-]|dummy|sample|redacted|x{4}|\.{3}|^(?:1234|abc123|test|pass|secret)"


def _distinct(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "(?<=.)(?=.)")))


def _random_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & (_distinct(value) >= BARE_CHARACTERS)


def _live_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDERS) & (_distinct(value) >= VALUE_CHARACTERS)


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN_VALUE, 1)


def _assigns(match: Column) -> Column:
    return F.length(_assigned(match)) >= 6


def candidates(docs: DataFrame, doc: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """id, row, repo, owner, base (spans) and found (array of start, end, hash, looks: the candidate values, each place once)."""
    txt = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    yes = lambda v: F.lit(True)
    rest = let(masked(txt, ASSIGN, _assigns), lambda a: let(masked(a, ACCESS, yes), lambda b: let(masked(b, HEX, yes), lambda c: found(c, BARE))))
    df = docs.select(
        F.col(f"`{doc}`").alias("id"),
        repository.cast("string").alias("repo"),
        owner.cast("string").alias("owner"),
        F.filter(found(txt, ASSIGN), lambda m: _assigns(m["value"])).alias("_assign"),
        found(txt, ACCESS).alias("_access"),
        found(txt, HEX).alias("_hex"),
        F.filter(rest, lambda m: _random_looking(m["value"])).alias("_bare"),
    )
    df = df.withColumn("base", F.concat(*[as_spans(F.col(f"_{k}"), i) for i, k in enumerate(BASE)]))

    def values(column: str) -> Column:
        def one(m: Column) -> Column:
            value = _assigned(m["value"]) if column == "_assign" else m["value"]
            looks = F.lit(True) if column == "_bare" else _live_looking(value)
            return F.struct((m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), F.unhex(F.md5(value)).alias("hash"), looks.alias("looks"))

        return F.transform(F.col(column), one)

    # the value of an assignment is often a hex or access span, too
    every = F.array_sort(F.concat(*[values(f"_{k}") for k in [*BASE, "bare"]]))
    once = let(every, lambda v: F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1)["start"] != x["start"]) | (F.get(v, i - 1)["end"] != x["end"])))
    return df.withColumn("found", once).select(F.monotonically_increasing_id().alias("row"), "id", "repo", "owner", "base", "found")


def ownership(rows: DataFrame) -> DataFrame:
    """hash, n (occurrences), repositories, owners: distinct in steps, so a hot value is reduced before it is shuffled.

    A null repository or owner is one of its own; a repository that several owners share counts once.
    """
    each = rows.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct(F.struct("repo")).alias("repositories"), F.count_distinct(F.struct("owner")).alias("owners"))


def secrets(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per document: doc, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_plain, ownership.

    repository and owner default to (source, lang) and source. spans has the base spans and, as kind live, the candidate
    values that look like credentials and aren't copied: those of base spans (for an assignment what is assigned) and bare
    ones. n_live counts these, n_copied the values that COPIED_OWNERS or more owners hold in as many repositories, n_plain all
    others (placeholders, plain words). ownership has start:end:owners:repositories of each value, comma-joined by start.
    Null texts are empty; a null owner is an owner of its own; repeated rows each get a row; other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    kept, _ = saved(candidates(docs, doc, text, repository, owner), "secrets")
    rows = kept.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    owned, _ = saved(ownership(rows), "owned")
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = skewed_left_join(rows.select("row", "hash", "start", "end", "looks"), owned, "hash", "n", total)
    copied = (F.col("owners") >= COPIED_OWNERS) & (F.col("repositories") >= COPIED_OWNERS)
    live = F.col("looks") & ~copied
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(live, F.struct("start", F.lit(len(BASE)).alias("kind"), "end"))).alias("more"),
        F.count_if(live).alias("n_live"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(~live & ~copied).alias("n_plain"),
        F.collect_list(F.struct("start", "end", "owners", "repositories")).alias("held"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = kept.filter(F.size("found") > 0).join(by_row, "row", "left").unionByName(kept.filter(F.size("found") == 0), allowMissingColumns=True)
    held = F.transform(F.array_sort("held"), lambda c: F.concat_ws(":", c["start"], c["end"], c["owners"], c["repositories"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("id").alias(doc),
        *[count(k) for k in BASE],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", F.coalesce("more", empty)), KINDS).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "n_plain")],
        F.coalesce(F.array_join(held, ","), F.lit("")).alias("ownership"),
    )
