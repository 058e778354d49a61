"""Secret scans with DataFrame functions only: patterns, then corpus-wide ownership of each candidate.

A candidate that at least `widely` owners hold is a copied example. So is one that is spread over `2 * widely` repositories or
more, of which no owner holds more than `MAINLY`: an owner's own credential may stand in all of its repositories, and a
few strays beside them, but isn't spread evenly. All others look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, text_or_empty

# Kind, pattern, group of the secret, shortest secret; the first three are the base.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 40),
)
BASE = 3
WIDELY = 3
MAINLY = 0.75
MASK = "[secret]"
SPAN = "array<struct<start:int,kind:int,end:int,secret:string>>"


def kind_spans(text: Column, kind: int) -> Column:
    """The matches of one kind from left to right: start, kind, end in code points, and the secret's hash.

    Matches and the gaps between them alternate, so their lengths give the places.
    """
    _, pattern, group, least = KINDS[kind]
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        secret = F.regexp_extract(x["m"], pattern, group)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(secret, 256).alias("secret"))
        good = x["m"].isNotNull() & (F.length(secret) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(both, zero, step)["out"]).otherwise(F.array().cast(SPAN))


def find_candidates(df: DataFrame, text: Column) -> Column:
    return F.array_sort(F.concat(*[kind_spans(text, k) for k in range(len(KINDS))]))


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, n_places, n_repos, n_owners, main_share) from (secret, owner, repo): main_share is the largest owner's part of the
    repositories. Sums first by secret, owner and repository, so that a hot candidate is a few rows afterwards."""
    each = candidates.groupBy("secret", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("n_places"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), (F.max("repos") / F.sum("repos")).alias("main_share"))


def looks_live(widely: int) -> Column:
    """From the columns of `ownership`."""
    spread = (F.col("n_repos") >= 2 * widely) & (F.col("main_share") <= MAINLY)
    return (F.col("n_owners") < widely) & ~spread


def secret_scan(df: DataFrame, keep: list[str], text_col: str = "text", owner: Column | None = None, repo: Column | None = None, widely: int = WIDELY) -> tuple[DataFrame, str]:
    """The kept columns and an array of spans (start, kind, end, secret, live), whose name is returned too.

    The owner is the source and the repository the source and language unless columns are given. A null text counts
    as empty; a null owner or repository is one of its own. Repeated rows each keep their spans and count as places of
    one repository. An empty table gives no rows; other columns pass through under their names.
    """
    name = free_name(df, "spans")
    row, own, rep, rated_spans = (free_name(df, x) for x in ("row_key", "owner_key", "repo_key", "rated_spans"))
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    cols = [F.col(f"`{c}`") for c in keep]
    scan = df.select(*cols, F.monotonically_increasing_id().alias(row), F.coalesce(owner.cast("string"), F.lit("")).alias(own), F.coalesce(repo.cast("string"), F.lit("")).alias(rep), find_candidates(df, text_or_empty(f"`{text_col}`")).alias(name))
    scan = materialize(scan, "secrets")  # fixes the row keys and saves a second pass of the patterns
    some = scan.filter(F.size(name) > 0)
    each = some.select(F.col(row).alias("row"), F.col(own).alias("owner"), F.col(rep).alias("repo"), F.explode(name).alias("s"))
    rated = ownership(each.select("s.secret", "owner", "repo")).select("secret", looks_live(widely).alias("live"))
    spans = each.select("row", "s.*").join(rated, "secret").groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "secret", "live"))).alias(rated_spans))
    with_spans = some.join(spans, row).select(*cols, F.col(rated_spans).alias(name))
    none = scan.filter(F.size(name) == 0).select(*cols, F.array().cast("array<struct<start:int,kind:int,end:int,secret:string,live:boolean>>").alias(name))
    return none.unionByName(with_spans), name


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < BASE)


def found_spans(spans: Column) -> Column:
    """Base spans, and those of the other kinds that look live."""
    return F.filter(spans, lambda s: (s["kind"] < BASE) | s["live"])


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask_live(text: Column, spans: Column) -> Column:
    """The text with each live span replaced; overlapping spans are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    live = F.filter(spans, lambda s: s["live"])
    done = F.aggregate(live, start, step)
    return F.when(F.size(live) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
