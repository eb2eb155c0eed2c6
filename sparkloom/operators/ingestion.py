"""Requests, URLs, manifests and submodules: validation as ordered rules, integrity as joins, resolution as bounded expansion."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from ..functions import dims
from ..functions.text import bound, first_match
from ..scratch import Scratch


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, user_info, host (lower case, brackets and port off), path by regular expressions; empty where absent."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    after = F.regexp_replace(authority, r"^.*@", "")
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "user_info": F.when(authority.contains("@"), F.regexp_replace(authority, r"@[^@]*$", "")).otherwise(""),
        "host": F.lower(F.regexp_extract(after, r"^(\[[^\]]*\]|[^:]*)", 1)),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
    }


# IPv4 ranges that are private or reserved, as first and last number.
def _range(first: str, bits: int) -> tuple[int, int]:
    a, b, c, d = map(int, first.split("."))
    low = a << 24 | b << 16 | c << 8 | d
    return low, low + (1 << (32 - bits)) - 1


BLOCKED_V4 = [_range(*r) for r in (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))]


def ipv4_number(host: Column) -> Column:
    """The address as a number, null unless four decimal parts of at most 255 without leading zeros."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    p = F.split(host, r"\.")
    number = sum((F.try_element_at(p, F.lit(k + 1)).cast("long") * (256 ** (3 - k)) for k in range(1, 4)), F.try_element_at(p, F.lit(1)).cast("long") * 256**3)
    return F.when(host.rlike(rf"^{part}(\.{part}){{3}}$"), number)


@F.pandas_udf(BooleanType())
def ipv6_blocked(hosts: pd.Series) -> pd.Series:
    """Whether a host is an IPv6 address of a private, reserved, local or multicast range; only hosts with a colon are looked at."""
    import ipaddress

    def test(h: str | None) -> bool:
        try:
            ip = ipaddress.IPv6Address(h)
        except ValueError:
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified

    return hosts.map(lambda h: bool(h) and ":" in h and test(h.strip("[]")))


def ssrf_blocked(host: Column, with_v6: bool = False) -> Column:
    """localhost, and IP literals of private and reserved ranges; IPv6 by a vectorised UDF, only if asked for."""
    inside = F.exists(F.array(ipv4_number(host)), lambda n: reduce(lambda a, b: a | b, (n.between(low, high) for low, high in BLOCKED_V4)))
    out = host.isin("localhost", "127.0.0.1", "::1", "[::1]", "0.0.0.0") | F.coalesce(inside, F.lit(False))
    return out | ipv6_blocked(host) if with_v6 else out


def safe_ref(ref: Column) -> Column:
    return ref.rlike(r"^[a-zA-Z0-9_\-./]+$")


def sha_like(sha: Column) -> Column:
    return sha.rlike(r"(?i)^[0-9a-f]{7,40}$")


def validate_request(url: Column, branch: Column, sha: Column, depth: Column, credential: Column, schemes=("https",), with_v6: bool = False) -> Column:
    """The name of the first rule that a request breaks, null if none."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return bound(_parts(url, with_v6), lambda p: first_match(
        (blank(url), "url_missing"),
        (F.length(url) > 512, "url_too_long"),
        (~p["scheme"].isin(list(schemes)), "scheme"),
        (p["user_info"] != "", "credentials_in_url"),
        (p["host"] == "", "no_host"),
        (ssrf_blocked(p["host"]) | p["blocked"], "ssrf"),
        (~F.coalesce(safe_ref(branch), F.lit(False)), "branch"),
        (~blank(sha) & ~sha_like(sha), "commit_sha"),
        (depth < 1, "depth"),
        (blank(credential), "credential_ref"),
    ))


def _parts(url: Column, with_v6: bool = False) -> Column:
    p = url_parts(url)
    blocked = ipv6_blocked(p["host"]) if with_v6 else F.lit(False)
    return F.struct(p["scheme"].alias("scheme"), p["user_info"].alias("user_info"), p["host"].alias("host"), blocked.alias("blocked"))


def validate_submodule(url: Column, path: Column) -> Column:
    """The name of the first rule that a submodule entry breaks: its URL's, then its path's; null if none. Relative URLs come resolved."""
    return bound(_parts(url), lambda p: first_match(
        (F.coalesce(url, F.lit("")) == "", "empty_url"),
        (url.startswith("/") | url.startswith("file://"), "filesystem_url"),
        (~p["scheme"].isin("https", "http"), "scheme"),
        (p["user_info"] != "", "credentials_in_url"),
        (p["host"] == "", "no_host"),
        (ssrf_blocked(p["host"]), "ssrf"),
        (F.coalesce(path, F.lit("")) == "", "empty_path"),
        (path.startswith("/") | path.contains("\\") | path.contains("\x00"), "absolute_path"),
        (F.array_contains(F.split(path, "/"), ".."), "path_escapes"),
    ))


def resolve_relative(url: Column, parent: Column) -> Column:
    """./ and ../ URLs against their parent's (a trailing .git kept off); others as they are; null if they climb out of the path."""
    base = F.regexp_replace(F.regexp_replace(parent, "/+$", ""), r"\.git$", "")
    origin = F.regexp_extract(base, r"^[a-z]+://[^/]+", 0)
    parts = F.filter(F.split(F.substr(base, F.length(origin) + 1), "/"), lambda x: x != "")
    rest = F.regexp_replace(url, r"^(\./)+", "")
    climbs = (F.length(F.regexp_extract(rest, r"^(\.\./)*", 0)) / 3).cast("int")
    left = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - climbs, F.lit(0)))
    joined = F.concat_ws("/", origin, F.array_join(left, "/"), F.regexp_replace(rest, r"^(\.\./)+", ""))
    tidy = F.regexp_replace(joined, "(?<!:)//+", "/")
    return F.when(url.startswith("../") | url.startswith("./"), F.when(climbs <= F.size(parts), tidy)).otherwise(url)


# Hosts of providers, first match wins.
PROVIDERS = [(r"^https://github\.com/[^/]+/[^/]+", "github"), (r"^https://gitlab\.com/[^/]+/[^/]+", "gitlab"), (r"^https://bitbucket\.org/[^/]+/[^/]+", "bitbucket"), (r"^https://(dev\.azure\.com|[^/]+\.visualstudio\.com)/", "azure")]


def provider(url: Column, table=PROVIDERS) -> Column:
    return first_match(*((url.rlike(p), name) for p, name in table), otherwise="none")


# Adapters and whether they make calls; the others only know their urls.
ADAPTERS = [("github", True), ("gitlab", False), ("bitbucket", False), ("azure", False), ("none", False)]


def adapter(url: Column) -> tuple[Column, Column]:
    """(provider, error) of the adapter that a url asks for: null where it makes calls, else ADAPTER_NOT_IMPLEMENTED."""
    name = provider(url)
    return name, F.when(~name.isin([a for a, calls in ADAPTERS if calls]), F.lit("ADAPTER_NOT_IMPLEMENTED"))


def owner_repo(url: Column) -> tuple[Column, Column]:
    parts = F.filter(F.split(url_parts(url)["path"], "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\.git$", "")


def rate_limit_low(remaining: Column, limit: Column) -> Column:
    """Fewer left than 10 or than 5 % of the limit."""
    return remaining < F.greatest(F.lit(10.0), limit * 0.05)


def http_error(status: Column, remaining: Column) -> Column:
    return first_match((status.isin(401), "AuthError"), ((status == 403) & (remaining == 0), "RateLimitError"), (status == 429, "RateLimitError"), (status == 403, "AuthError"), (status == 404, "NotFoundError"), (status >= 500, "ServerError"), (status >= 400, "FetchError"))


def pin_matches(expected: Column, actual: Column) -> Column:
    """Either is a prefix of the other; false if one can't be read."""
    a, b = F.lower(expected), F.lower(actual)
    return F.coalesce((a != "") & (b != "") & (a.startswith(b) | b.startswith(a)), F.lit(False))


def manifest(files: DataFrame) -> DataFrame:
    """relative_path, sha256, size_bytes, is_binary from binary files (path, content, length): by suffix, or a NUL in the first 8 KB."""
    suffix = F.col("path").rlike(r"(?i)\.(png|jpe?g|gif|ico|pdf|zip|gz|tar|jar|class|so|dll|exe|bin|woff2?|pyc)$")
    return files.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), (suffix | F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))).alias("is_binary"))


def walk_manifest(files: DataFrame, links: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, refused) of files (path relative to base, content, length) and the symbolic links among them (path, target).

    Skipped directories are left out. No link is followed: one that stays within base is left out, one that leads out of it is refused, a row (path, rule) each.
    """
    from ..sources.readers import walked

    known = files.where(walked(F.col("path"), dims.MANIFEST_SKIPPED_DIRS))
    refused = links.where(walked(F.col("path"), dims.MANIFEST_SKIPPED_DIRS) & symlink_escapes(F.col("path"), F.col("target"), base)).select("path", F.lit("symlink_escape").alias("rule"))
    return manifest(known.join(links.select("path").distinct(), "path", "left_anti")), refused


def verify_delivery(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """relative_path, status: ok, tampered, missing or extra: one full join on the path."""
    j = expected.select("relative_path", F.col("sha256").alias("_a")).join(delivered.select("relative_path", F.col("sha256").alias("_b")), "relative_path", "full")
    return j.select("relative_path", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "ok").otherwise("tampered").alias("status"))


def resolve_submodules(roots: DataFrame, modules: DataFrame, max_depth: int = 2, max_total: int = 50) -> DataFrame:
    """root, url, sha, path, depth, status for submodules reached from roots (url) through modules (parent_url, url, sha, path).

    Entries are met depth-first, a parent's in the order of their paths. For each, in this order: once max_total of the root are resolved,
    over_limit; below max_depth, too_deep; unpinned; rejected by its URL or path; circular, if its (url, sha) was met before; else
    resolved. Only resolved entries lead on. Each level is one equi join and written out; the rules are evaluated once for each module.
    """
    scratch = Scratch(roots.sparkSession, "submodules")
    rules = modules.select("parent_url", "url", F.coalesce("sha", F.lit("")).alias("sha"), "path", validate_submodule(F.col("url"), F.col("path")).isNotNull().alias("bad"))
    rules = scratch.put(rules, "modules")
    level = roots.select(F.col("url").alias("root"), F.col("url").alias("parent_url"), F.array().cast("array<int>").alias("place"))
    every: DataFrame | None = None
    for depth in range(1, max_depth + 2):
        place = F.row_number().over(Window.partitionBy("root", "place").orderBy("path", "url", "sha"))
        base = first_match((F.lit(depth > max_depth), "too_deep"), (F.col("sha") == "", "unpinned"), (F.col("bad"), "rejected"), otherwise="resolved")
        found = scratch.put(level.join(rules, "parent_url").select("root", "url", "sha", "path", F.lit(depth).alias("depth"), base.alias("base"), F.concat("place", F.array(place)).alias("place")), "level")
        every = found if every is None else every.unionByName(found)
        level = found.where("base = 'resolved'").select("root", F.col("url").alias("parent_url"), "place")
    above = F.transform(F.sequence(F.lit(1), F.size("place") - 1), lambda k: F.slice("place", F.lit(1), k))
    again: DataFrame | None = None
    for _ in range(max_depth + 1):  # what stands below a circular entry is not met, and hides nothing: each round settles a level more
        live = every
        if again is not None:
            below = every.where("depth > 1").select("root", "place", F.explode(above).alias("up")).join(again.withColumnRenamed("place", "up"), ["root", "up"], "left_semi").select("root", "place").distinct()
            live = every.join(below, ["root", "place"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("root", "url", "sha", "base").orderBy("place"))
        live = scratch.put(live.withColumn("status", F.when((F.col("base") == "resolved") & (nth > 1), "circular").otherwise(F.col("base"))), "live")
        again = live.where("status = 'circular'").select("root", "place")
        if again.isEmpty():
            break
    before = F.count_if(F.col("status") == "resolved").over(Window.partitionBy("root").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    limited = scratch.put(live.withColumn("over", F.coalesce(before, F.lit(0)) >= max_total), "limited")
    gone = limited.where("over").select("root", F.col("place").alias("up"))
    kept = limited.withColumn("up", F.slice("place", F.lit(1), F.size("place") - 1)).join(gone, ["root", "up"], "left_anti")
    return kept.select("root", "url", F.nullif("sha", F.lit("")).alias("sha"), "path", "depth", F.when(F.col("over"), "over_limit").otherwise(F.col("status")).alias("status"))


def path_allowed(path: Column, base: str) -> Column:
    """Whether a path, relative to base or absolute, stays strictly within base once its . and .. parts are resolved."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.coalesce((resolved == base.rstrip("/")) | resolved.startswith(base.rstrip("/") + "/"), F.lit(False)) & ~F.coalesce(path.contains("\x00"), F.lit(True))


def symlink_escapes(path: Column, target: Column, base: str) -> Column:
    """Whether a link at path (relative to base) leads out of base; a target is absolute or relative to the link's folder."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return ~path_allowed(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)), base)


#: Repositories above this many MB are never fetched.
MOST_MB = 2048


def prefetch_decision(size_kb: Column, limit_mb: Column, archived: Column, asked_sha: Column, head_sha: Column, error: Column) -> tuple[Column, Column, Column]:
    """(outcome, commit, warning) of a repository's metadata: outcome go on or the fatal reason; commit to fetch; warning or null.

    error is the adapter's error class, null if metadata came. A fatal error is one of not found, rate limit and authentication, or any
    where no commit was asked for.
    """
    full = F.length(F.coalesce(head_sha, F.lit(""))) == 40
    too_large = size_kb / 1024 > F.least(limit_mb, F.lit(MOST_MB))
    failed = error.isNotNull()
    outcome = first_match(
        (error == "RepositoryNotFoundError", "not_found"), (error == "RateLimitError", "rate_limit"), (error.isin("AuthenticationError", "PermissionDeniedError"), "auth"),
        (failed & asked_sha.isNull(), "no_sha"), (failed, "go_on"), (too_large, "too_large"), otherwise="go_on",
    )
    commit = F.when(outcome == "go_on", F.coalesce(asked_sha, F.when(full, head_sha)))
    warning = first_match((outcome != "go_on", outcome), (failed, "metadata_failed"), (archived, "archived"), (asked_sha.isNull() & ~full, "incomplete_sha"), (full & (head_sha != asked_sha), "sha_mismatch"), otherwise=F.lit(None).cast("string"))
    return outcome, commit, warning


def failure_rows(requests: DataFrame, stage: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(results, audit) of requests that failed: one row each, never an exception; credentials stay out of both."""
    plain = requests.drop("credential", "credential_ref", "token").withColumns({"stage": stage, "error": error, "status": F.lit("failed")})
    return plain, plain.select("session_id", F.lit("ingestion_failed").alias("event"), "stage", "error")


def without_secrets(rows: DataFrame, names: tuple[str, ...] = ("token", "credential", "password", "secret", "private_key")) -> DataFrame:
    """The rows without columns named as secrets, for logs and documents."""
    return rows.select(*[c for c in rows.columns if not any(n in c.lower() for n in names)])


def ingest(requests: DataFrame, metadata: DataFrame, files: DataFrame, approved: DataFrame) -> dict[str, DataFrame]:
    """The ingestion stages as one composition: requests are validated, looked up, sized and pinned, their files hashed and delivered.

    requests: session_id, url, branch, sha, depth, credential; metadata: url, size_kb, archived, head_sha, error; files: session_id, path, content,
    length; approved: session_id, relative_path, sha256. A request gives rows in ``failed`` and ``audit``, or in ``manifest`` and ``results``,
    never in both: a file that is missing or other than approved fails its whole request.
    """
    rule = validate_request(F.col("url"), F.col("branch"), F.col("sha"), F.col("depth"), F.col("credential"))
    looked_up = requests.withColumn("rule", rule).join(metadata, "url", "left")
    outcome, commit, warning = prefetch_decision(F.col("size_kb"), F.lit(MOST_MB), F.coalesce("archived", F.lit(False)), F.col("sha"), F.col("head_sha"), F.coalesce("error", F.when(F.col("size_kb").isNull(), "AdapterError")))
    judged = looked_up.withColumns({"reason": F.coalesce("rule", F.nullif(outcome, F.lit("go_on"))), "commit": commit, "warning": warning})
    hashed = files.select("session_id", F.col("path").alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    checked = approved.withColumnRenamed("sha256", "want").join(hashed, ["session_id", "relative_path"], "full")
    broken = checked.where("want is null or sha256 is null or want <> sha256").select("session_id").distinct().withColumn("broken", F.lit("integrity"))
    judged = judged.join(broken, "session_id", "left").withColumn("reason", F.coalesce("reason", "broken"))
    stage = first_match((F.col("rule").isNotNull(), "validate"), (F.col("broken").isNotNull() & (F.col("reason") == "integrity"), "deliver"), otherwise="prefetch")
    failed, audit = failure_rows(judged.where("reason is not null").select("session_id", "url", "branch", "reason", stage.alias("at")), F.col("at"), F.col("reason"))
    good = judged.where("reason is null")
    manifest_ = hashed.join(good.select("session_id"), "session_id", "left_semi")
    sums = manifest_.groupBy("session_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    results = good.join(sums, "session_id", "left").select("session_id", "url", "branch", "commit", "warning", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit("ok").alias("status"))
    return {"failed": failed.drop("at", "reason"), "audit": audit, "manifest": manifest_, "results": results}
