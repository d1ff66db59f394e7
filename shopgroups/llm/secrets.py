"""Secret scans with corpus-wide ownership frequency.

Candidates are found by regular expressions, as spans in code points. Their
value hashes are aggregated over the whole corpus by distinct repositories and
owners: a value that many owners or very many repositories hold is a copied
example, one that stays with few and does not look like a placeholder is a
live-looking credential.

Spans without Python: a text split by a pattern gives the lengths between the
matches, ``regexp_extract_all`` the matches; a running sum over both, in a
window of slim rows per text, gives the positions in linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored, text_or_empty, unused, work_folder

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
#: Added by the method: long opaque tokens; kept only where ownership shows them as live.
OPAQUE = r"([A-Za-z0-9_-]{32,})"

#: kind, pattern, shortest value, substrings of the lower-case text of which a match needs one (none: always scanned)
KINDS = (
    ("assign", ASSIGN, 6, ("passw", "secret", "token", "apikey", "api_key")),
    ("access", ACCESS, 20, ("akia",)),
    ("hex", HEX, 24, ()),
    ("opaque", OPAQUE, 32, ()),
)
BASE = 3
#: Values from so many owners on, or from so many repositories on, are widely copied examples.
COPIED_OWNERS, COPIED_REPOS = 3, 100
#: Parts of placeholder values, in their longest forms, in values without separators.
PLACEHOLDERS = ("(?i)example|changeme|placeholder|your(?:api|secret|access|auth)?(?:key|token|password|secret|id)?(?:here)?|dummy|sample"
                    "|x{4,}|0{4,}|1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?")


def mostly_placeholder(value) -> "F.Column":
    """Whether parts of placeholders make up more than half of the value, separators left out."""
    bare = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    return 2 * F.length(F.regexp_replace(bare, PLACEHOLDERS, "")) < F.length(bare)


def find_candidates(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per candidate, and one row with a null kind per text without any.

    Columns: uid (of the input row), id_col, repo, owner, kind_no, start, stop, value_hash, placeholder.
    """
    text, lowered = F.col("_text"), F.col("_low")
    rows = (df.select(F.col(id_col).alias("rec_id"), text_or_empty(text_col).alias("_text"),
                      F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
            .withColumn("uid", F.monotonically_increasing_id()).withColumn("_low", F.lower("_text")))
    found = []
    for no, (kind, pattern, shortest, needs) in enumerate(KINDS):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        gaps = F.split(text, pattern, -1)
        hits = F.transform(
            F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g")),
            lambda h, i: F.struct(
                F.lit(no).alias("kind_no"), i.alias("pos"), F.length(h["g"]).alias("gap"), F.length(h["w"]).alias("len"),
                (F.length(h["v"]) >= shortest).alias("long"), F.xxhash64(h["v"]).alias("value_hash"),
                (F.lit(True) if no < BASE else h["v"].rlike("[0-9]") & h["v"].rlike("[a-z]") & h["v"].rlike("[A-Z]")).alias("shaped"),
                mostly_placeholder(h["v"]).alias("placeholder")))
        if needs:
            may = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(s)) for s in needs))
        else:
            may = text.rlike(pattern)
        found.append(F.when(may, hits))
    none = F.array().cast("array<struct<kind_no:int,pos:int,gap:int,len:int,long:boolean,value_hash:bigint,shaped:boolean,placeholder:boolean>>")
    hits = F.concat(*[F.coalesce(f, none) for f in found])
    flat = rows.select("uid", "rec_id", "repo", "owner", F.explode_outer(hits).alias("h")).select(
        "uid", "rec_id", "repo", "owner", "h.*")
    along = Window.partitionBy("uid", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("len")).over(along)
    flat = flat.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("len"))
    keep = F.col("long") & F.col("shaped")
    # failing matches only mark that the text was read
    return flat.select("uid", "rec_id", "repo", "owner", *[
        F.when(keep, F.col(c)).alias(c) for c in ("kind_no", "start", "stop", "value_hash", "placeholder")])


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners per value; a null repository or owner counts as one of its own."""
    pairs = (candidates.filter("kind_no is not null")
             .groupBy("value_hash", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).agg(F.count("*").alias("n")))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(candidates: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """Candidates with n_repos, n_owners and status: ``copied`` (held by ``copied_owners`` or more
    owners, or in ``copied_repos`` or more repositories of any), ``placeholder``, or ``live``. Rows with a null kind stay, with a null status."""
    status = (F.when(F.col("kind_no").isNull(), None).when((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos), "copied")
              .when(F.col("placeholder"), "placeholder").otherwise("live"))
    # texts without a candidate need no owners, and would all have one join key
    plain, none = F.col("kind_no").isNotNull(), F.lit(None).cast("long")
    owned = candidates.filter(plain).join(ownership(candidates), "value_hash", "left")
    other = candidates.filter(~plain).withColumns({"n_repos": none, "n_owners": none})
    return owned.unionByName(other).withColumn("status", status)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
                 owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """Secrets of every text, one row per input row.

    Returns uid, id_col and ``found``: array of (start, kind_no, stop, status, n_repos, n_owners),
    by start, then kind. Base kinds are always in it; an ``opaque`` span only if it is live and
    overlaps no base span. Without another column for repositories every document counts as one.

    Null or empty text: an empty array. Repeated rows or ids: each row has its own result and
    counts once per (repository, owner). Empty input: no rows. Other columns are ignored.
    """
    found = find_candidates(df, id_col, text_col, repo_col, owner_col)
    # the slim candidates are read twice, the texts once
    c = judged(stored(found, work_folder(df.sparkSession, "secrets"), "candidates"), copied_owners, copied_repos)
    span = F.struct("start", "kind_no", "stop", "status", "n_repos", "n_owners")
    spans = F.array_sort(F.collect_list(F.when(F.col("kind_no").isNotNull(), span)))
    out = c.groupBy("uid").agg(F.first("rec_id").alias(id_col), spans.alias("all"))
    base = F.filter("all", lambda s: s["kind_no"] < BASE)
    live = lambda s: (s["kind_no"] < BASE) | (
        (s["status"] == "live") & ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return out.select("uid", id_col, F.filter("all", live).alias("found"))


def named(spans) -> "F.Column":
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["stop"])), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents; owners are the sources."""
    out = scan_secrets(documents(spark, sf_dir))
    of = lambda no: F.size(F.filter("found", lambda s: s["kind_no"] == no)).cast("long")
    is_status = lambda v: F.size(F.filter("found", lambda s: s["status"] == v)).cast("long")
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                      F.sha2(named(F.filter("found", lambda s: s["kind_no"] < BASE)).cast("binary"), 256).alias("base_sha256"),
                      named(F.col("found")).alias("spans"),
                      is_status("live").alias("n_live"), is_status("copied").alias("n_copied"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every live span of its texts replaced by ``mark``; copied examples and
    values that are mostly placeholder stay. Null and repeated ids: each row has its own spans. Null text
    stays null, empty text empty; empty input: no rows. ``n_chars``, if there, follows the text."""
    columns, key = df.columns, id_col
    match, live = unused(columns, "_match"), unused(columns, "_live")
    ids = df.agg(F.count("*").alias("n"), F.count(id_col).alias("filled"), F.count_distinct(id_col).alias("distinct")).first()
    if not ids["n"] == ids["filled"] == ids["distinct"]:
        # row numbers instead, which both reads of the texts must share
        key = unused(columns, "_row")
        df = stored(df.withColumn(key, F.monotonically_increasing_id()), work_folder(df.sparkSession, "redact"), "rows")
    slim = df.select(F.col(key).alias("key"), F.col(id_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"))
    found = scan_secrets(slim, "key", "text", "repo", "owner", copied_owners, copied_repos)
    found = found.select(F.col("key").alias(match), F.filter("found", lambda s: s["status"] == "live").alias(live)).filter(F.size(live) > 0)
    joined = df.join(found, F.col(key) == F.col(match), "left")
    step = lambda acc, s: F.when(
        s["stop"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                     F.when(s["start"] >= acc["at"], mark).otherwise("")).alias("out"), s["stop"].alias("at")))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(live, begin, step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(text_col))))
    cleaned = F.when(F.col(live).isNull(), F.col(text_col)).otherwise(done)
    out = joined.withColumn(text_col, cleaned)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
    return out.select(*columns)
