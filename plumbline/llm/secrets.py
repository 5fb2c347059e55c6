"""Secrets in text, told from widely copied examples by who owns the copies.

DataFrame expressions only.  Texts are read once, for the places and hashes of
candidates; what is shuffled afterwards are hashes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, stored

# Base kinds, in the order that breaks ties: pattern, group of the value, least length of the value.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Further candidates; they count as secrets only by their ownership.
MORE = {
    "vendor": (r"(?<![A-Za-z0-9])(?:gh[opsru]_|github_pat_|glpat-|xox[abprs]-|[srp]k_live_)[A-Za-z0-9_-]{16,}", 0, 20),
    "jwt": (r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 20),
    "mixed": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your|xxxx|0000000|12345678|abcdefgh"
MOST_OWNERS = 2      # a live credential has few owners; more make it an example
MOST_REPOSITORIES = 10   # and lies in few repositories, also those of one owner
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def spans(text: Column, kind: str, number: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points, failing ones dropped.

    The text between matches gives the places: the i-th match starts after i + 1
    gaps and i matches.
    """
    def placed(gaps):
        found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                             F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), gaps.alias("gap"))

        def step(state, m):
            start = state["at"] + F.char_length(m["gap"])
            end = start + F.char_length(m["all"])
            span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"),
                            F.lit(kind).alias("kind"), m["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).cast(SPAN).alias("out"))
        # the last gap has no match after it
        matches = F.filter(found, lambda m: m["all"].isNotNull())
        return F.aggregate(matches, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
                           step, lambda state: state["out"])
    some = let(F.split(text, pattern, -1), placed)
    return F.filter(F.when(text.rlike(pattern), some).otherwise(F.array().cast(SPAN)),
                    lambda s: F.char_length(s["value"]) >= least)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Base spans and further candidates of every row; nothing else of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {**BASE, **MORE}
    df = docs.select(F.col("doc_id"), F.coalesce(owner, F.lit("")).alias("owner"),
                     F.coalesce(repository, F.lit("")).alias("repository"),
                     *[spans(text, k, i, *kinds[k]).alias(k) for i, k in enumerate(kinds)])

    def apart(s, others):
        return ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))

    def live(s):
        v = s["value"]
        return ~v.rlike(PLACEHOLDER) & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    base = F.concat(*BASE)
    named = F.filter(F.concat("vendor", "jwt"), lambda s: apart(s, base))
    mixed = F.filter("mixed", lambda s: live(s) & apart(s, F.concat(base, named)))
    return df.select("doc_id", "owner", "repository", base.alias("base"), F.transform(
        F.concat(base, F.filter(named, lambda s: ~s["value"].rlike(PLACEHOLDER)), mixed),
        lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"], F.xxhash64(s["value"]).alias("hash"),
                           s["value"].rlike(PLACEHOLDER).alias("placeholder"))).alias("candidates"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)`` from ``(hash, owner, repository)``, one row per candidate.

    Three grouped counts, each combined on the map side, so a value that a third
    of all rows copy costs each task one row per owner and repository.
    """
    return candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")) \
        .groupBy("hash", "owner").agg(F.count("*").alias("r")) \
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def find_secrets(docs: DataFrame, text_col: str = "text", owner: Column | None = None,
                 repository: Column | None = None, most_owners: int = MOST_OWNERS,
                 most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per document: base spans, all spans, and how many look live or copied.

    A candidate is live when at most ``most_owners`` owners and at most
    ``most_repositories`` repositories hold its value and it is no placeholder;
    else it is an example.  Without a column for it, a document is a repository
    of its source and language.  ``ownership`` lists every candidate with its
    owners and repositories.  Base spans always stay;
    further ones are added when live.  Rows that repeat an id give a row each; a
    null or empty text has no span, a null owner is an owner like any other.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang", "doc_id") if repository is None else repository
    seen = stored(scan(docs, text_col, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = seen.select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    ruled = each.join(ownership(each.select("hash", "owner", "repository")), "hash").select(
        "row", "start", "kind_no", "end", "kind", "owners", "repositories",
        ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories) & ~F.col("placeholder")).alias("live"))
    per_row = ruled.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") | (F.col("kind_no") < len(BASE)),
                                           F.struct("start", "kind_no", "end", "kind")))).alias("kept"),
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "owners", "repositories"))).alias("counted"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    out = seen.join(per_row, "row", "left")

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *[n(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("kept")), F.lit("")).alias("spans"),
        F.coalesce(F.array_join(F.transform("counted", lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"], s["owners"], s["repositories"])), ","), F.lit("")).alias("ownership"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
