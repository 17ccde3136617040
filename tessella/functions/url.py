"""URL scalars as Columns. Null and blank URLs are returned as they are; parts of them are empty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = (
    "_ga _gid _gl dclid fbclid gclid gclsrc igshid mc_cid mc_eid msclkid ref "
    "referrer s_kwcid source twclid utm_campaign utm_cid utm_content utm_id utm_medium utm_reader utm_source utm_term yclid"
).split()
TWO_PART_TLDS = (
    "ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn "
    "com.co com.hk com.mx com.pe com.sg com.tw go.jp gov.uk ne.jp net.au or.jp org.au org.uk"
).split()
#: scheme, authority, path, query, fragment of RFC 3986, appendix B.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _url(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def part(c: Column | str, n: int) -> Column:
    return F.regexp_extract(F.trim(_url(c)), _PARTS, n)


def scheme(c) -> Column:
    return F.lower(part(c, 1))


def domain(c) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(c, 2)), "^[^@]*@", ""), ":[0-9]*$", "")


def bare_domain(c) -> Column:
    return F.regexp_replace(domain(c), r"^www\.", "")


def base_domain(c) -> Column:
    """The registered domain: the last two labels, or three under a two-part suffix."""
    labels = F.split(bare_domain(c), r"\.", -1)
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when((F.size(labels) >= 3) & last(2).isin(TWO_PART_TLDS), last(3)).when(F.size(labels) >= 2, last(2)).otherwise(bare_domain(c))


def subdomain(c) -> Column:
    host, base = bare_domain(c), base_domain(c)
    return F.when((host == base) | (base == ""), "").otherwise(F.left(host, F.length(host) - F.length(base) - 1))


def tld(c) -> Column:
    return F.when(domain(c).contains("."), F.element_at(F.split(domain(c), r"\.", -1), -1)).otherwise("")


def path(c) -> Column:
    return F.when(part(c, 3) == "", "/").otherwise(part(c, 3))


def path_segments(c) -> Column:
    return F.filter(F.split(part(c, 3), "/", -1), lambda s: s != "")


def path_depth(c) -> Column:
    return F.size(path_segments(c))


def extension(c) -> Column:
    ext = F.lower(F.regexp_extract(part(c, 3), r"(\.[^./]{1,9})$", 1))
    return ext


def origin(c) -> Column:
    return F.when((part(c, 1) == "") | (part(c, 2) == ""), "").otherwise(F.concat(part(c, 1), F.lit("://"), part(c, 2)))


def robots_url(c) -> Column:
    return F.concat(origin(c), F.lit("/robots.txt"))


def sitemap_url(c) -> Column:
    return F.concat(origin(c), F.lit("/sitemap.xml"))


def favicon_url(c) -> Column:
    return F.concat(origin(c), F.lit("/favicon.ico"))


def remove_fragment(c) -> Column:
    return F.split_part(_url(c), F.lit("#"), F.lit(1))


def set_fragment(c, fragment: str) -> Column:
    return F.concat(remove_fragment(c), F.lit(f"#{fragment}" if fragment else ""))


def is_http(c) -> Column:
    return scheme(c).isin("http", "https")


def is_valid(c) -> Column:
    return is_http(c) & domain(c).contains(".")


def query_params(c) -> Column:
    """map<string, array<string>>, values in order of appearance."""
    pairs = F.filter(F.split(part(c, 4), "&", -1), lambda p: p != "")
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    keys = F.array_distinct(F.transform(pairs, key))
    values = lambda k: F.transform(F.filter(pairs, lambda p: key(p) == k), lambda p: F.substring(p, F.length(k) + 2, F.length(p)))
    return F.map_from_arrays(keys, F.transform(keys, values))


def without_params(c, names: list[str]) -> Column:
    kept = F.array_join(F.filter(F.split(part(c, 4), "&", -1), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(names)), "&")
    rest = F.regexp_replace(_url(c), r"\?[^#]*", "")
    head, tail = F.split_part(rest, F.lit("#"), F.lit(1)), part(c, 5)
    return F.concat(head, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), F.when(tail == "", "").otherwise(F.concat(F.lit("#"), tail)))


def normalize_query(q: Column) -> Column:
    """Without tracking parameters, sorted by name; values of a name stay in order."""
    kept = F.filter(F.split(q, "&", -1), lambda p: (p != "") & ~_tracking(F.lower(F.split_part(p, F.lit("="), F.lit(1)))))
    with_value = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    placed = F.transform(with_value, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["p"]), "&")


def _tracking(k: Column) -> Column:
    return k.isin(TRACKING) | k.startswith("utm_") | k.startswith("_ga") | k.startswith("fb")


def normalize(c) -> Column:
    """Lower-case scheme and host, no www., default port, doubled or trailing slashes, tracking or fragment; sorted query.

    Percent escapes in the query stay as written. Text without a scheme is returned unchanged.
    """
    u = _url(c)
    host = F.regexp_replace(F.lower(F.regexp_replace(part(c, 2), "^[^@]*@", "")), r"^www\.", "")
    user = F.regexp_extract(part(c, 2), "^([^@]*@)", 1)
    host = F.when(scheme(c) == "http", F.regexp_replace(host, ":80$", "")).when(scheme(c) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    p = F.regexp_replace(part(c, 3), "/{2,}", "/")
    p = F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    q = normalize_query(part(c, 4))
    done = F.concat(scheme(c), F.lit("://"), user, host, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when((part(c, 1) == "") | (part(c, 2) == ""), F.col(c) if isinstance(c, str) else c).otherwise(done)


BLOCKED_EXTENSIONS = (
    ".7z .avi .bmp .css .dmg .doc .docx .eot .exe .flv .gif .gz .ico .iso .jpeg .jpg .js "
    ".mov .mp3 .mp4 .pdf .png .ppt .pptx .rar .svg .tar .ttf .webp .wmv .woff .woff2 .xls .xlsx .zip"
).split()


def validate(c, max_length: int = 2048) -> Column:
    """'OK' or the first reason why a URL is refused."""
    u, host = _url(c), domain(c)
    ext = extension(c)
    return (
        F.when(F.trim(u) == "", "Empty URL")
        .when(F.length(u) > max_length, F.concat(F.lit("URL too long ("), F.length(u), F.lit(f" > {max_length})")))
        .when(~scheme(c).isin("http", "https"), F.concat(F.lit("Scheme '"), scheme(c), F.lit("' not allowed")))
        .when(host == "", "No hostname")
        .when(host.isin("::1 127.0.0.1 localhost".split()), "Localhost not allowed")
        .when(host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "IP address not allowed")
        .when(ext.isin(BLOCKED_EXTENSIONS), F.concat(F.lit("Extension '"), ext, F.lit("' is blocked")))
        .otherwise("OK")
    )


def template(c) -> Column:
    """The path with variable segments replaced by placeholders, and the sorted names of parameters."""
    segment = lambda s: (
        F.when(s == "", "")
        .when(s.rlike(r"^\d+$"), "{num}")
        .when(s.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "{uuid}")
        .when(s.rlike(r"(?i)^[0-9a-f]{16,}$"), "{hash}")
        .when(s.rlike(r"(?i)^v\d+(\.\d+)*$"), "{version}")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{date}")
        .when((F.length(s) > 15) & s.rlike("(?i)^[a-z0-9-]+$"), "{slug}")
        .when(s.rlike("(?i)^[a-z0-9_-]{1,15}$"), s)
        .otherwise("{var}")
    )
    p = F.array_join(F.transform(F.split(F.regexp_replace(part(c, 3), "/+$", ""), "/", -1), segment), "/")
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(part(c, 4), "&", -1), lambda x: x.rlike("^[^=]+=.")), lambda x: F.split_part(x, F.lit("="), F.lit(1)))))
    q = F.when(part(c, 4) == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("={val}"))), "&")))
    t = F.concat(p, q)
    return F.when(t == "", "/").otherwise(t)


CONTENT = "article blog docs documentation guide learn news post story tutorial".split()
NOISE = "account archive cart category checkout feed login privacy register signup tag terms".split()


def score(c, depth: Column | int = 0, depth_penalty: float = 0.1) -> Column:
    """Simple additive score of a link in 0..1."""
    p, segs = F.lower(part(c, 3)), path_segments(c)
    any_of = lambda ws: F.lit(False) if not ws else p.rlike("|".join(ws))
    d = F.lit(depth) if isinstance(depth, int) else depth
    s = (
        F.lit(0.5)
        + F.when(any_of(CONTENT), 0.15).otherwise(0.0)
        - F.when(any_of(NOISE), 0.2).otherwise(0.0)
        + F.when(F.exists(segs, lambda x: (F.length(x) > 15) & x.contains("-")), 0.1).otherwise(0.0)
        - 0.05 * F.size(F.filter(segs, lambda x: x.rlike(r"^\d+$")))
        - depth_penalty * d
        - F.when(part(c, 4) != "", 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression; ``*`` also matches slashes."""
    out = ""
    for ch in glob:
        out += {"*": ".*", "?": "."}.get(ch, "\\" + ch if ch in r".^$+{}()|\[]" else ch)
    return f"(?s)^{out}$"


def matches_globs(c, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any include pattern (or none given), and no exclude pattern, on the URL or its path."""
    hit = lambda globs: F.lit(False) if not globs else _url(c).rlike("|".join(map(glob_to_regex, globs))) | path(c).rlike("|".join(map(glob_to_regex, globs)))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


FILE_EXTENSIONS = (
    ".apk .avi .css .csv .dmg .doc .docx .exe .gif .gz .iso .jpeg .jpg .js .json .mov .mp3 .mp4 "
    ".pdf .png .ppt .pptx .svg .tar .txt .webm .webp .xls .xlsx .xml .zip"
).split()


def is_file(c) -> Column:
    return extension(c).isin(FILE_EXTENSIONS)


def same_domain(a, b) -> Column:
    """Whether both have the same registered domain, and one at all."""
    return (base_domain(a) == base_domain(b)) & (base_domain(a) != "")


def equal(a, b) -> Column:
    """Whether two URLs are the same once normalized; nulls are equal to each other alone."""
    return normalize(a).eqNullSafe(normalize(b))


def matches_regex(c, pattern: str) -> Column:
    return _url(c).rlike(pattern)


def _arrow(f, *columns) -> Column:
    """``f`` on the strings of Arrow batches, null as empty."""

    @F.pandas_udf("string")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*parts, strict=True)], dtype=object)

    return run(*[_url(c) for c in columns])


def join(base, relative) -> Column:
    """``relative`` resolved against ``base`` (RFC 3986); an absolute one stays."""
    from urllib.parse import urljoin

    def resolve(b: str, r: str) -> str:
        try:
            return urljoin(b, r)
        except ValueError:  # such as an unclosed bracket in the host
            return r

    return _arrow(resolve, base, relative)


def with_params(c, params: dict[str, str]) -> Column:
    """With ``params`` set, in place of former values of the same names; the others stay, in order."""
    from urllib.parse import parse_qs, urlencode, urlsplit

    def put(u: str) -> str:
        try:
            p = urlsplit(u)
            return p._replace(query=urlencode(parse_qs(p.query, keep_blank_values=True) | {k: [v] for k, v in params.items()}, doseq=True)).geturl()
        except ValueError:
            return u

    return _arrow(put, c)


def encode(c) -> Column:
    """Percent-encoded path and query; escapes already there are encoded again."""
    from urllib.parse import quote, urlsplit

    def escape(u: str) -> str:
        try:
            p = urlsplit(u)
            return p._replace(path=quote(p.path, safe="!$&'()*+,/:;=@"), query=quote(p.query, safe="&=")).geturl()
        except ValueError:
            return u

    return _arrow(escape, c)


def decode(c) -> Column:
    """Percent escapes as UTF-8; bytes that are none become U+FFFD, a plus stays."""
    from urllib.parse import unquote

    return _arrow(unquote, c)
