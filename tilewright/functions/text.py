"""Names, URLs, keys and magic bytes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quadkey(m: Column, x: Column, y_top: Column) -> Column:
    """Digits from the coarsest level; y from the top.  Empty at level 0."""
    bit = lambda v, i: F.call_function("shiftright", v, (i - 1).cast("int")).bitwiseAND(F.lit(1))
    digits = F.transform(F.sequence(m, F.lit(1), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y_top, i)).cast("string"))
    return F.when(m < 1, "").otherwise(F.array_join(digits, ""))


def tile_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    out = F.replace(template, F.lit("{z}"), z.cast("string"))
    return F.replace(F.replace(out, F.lit("{x}"), x.cast("string")), F.lit("{y}"), y.cast("string"))


def url_namespace(url: Column) -> Column:
    """A server's URL as a safe folder name of at most 80 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"(?i)^[a-z]+://", "")
    name = F.substring(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("server"))


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"<[^>]+>", ""))


def sniff_ext(content: Column) -> Column:
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(3) == "FFD8FF", ".jpg")
        .when(head(4) == "89504E47", ".png")
        .when(head(4).isin("49492A00", "4D4D002A"), ".tif")
        .otherwise(".bin")
    )


def content_kind(content: Column) -> Column:
    """What a tile content holds, by its magic; `error` if too small or unknown."""
    magic = F.substring(content, 1, 4)
    named = F.when(magic == b"glTF", "glb").when(magic == b"b3dm", "b3dm").when(magic == b"cmpt", "cmpt").when(magic.isin(b"pnts", b"i3dm"), "skip").otherwise("error")
    return F.when(F.length(content) < 12, "error").otherwise(named)


def is_tileset_uri(uri: Column) -> Column:
    """Whether the path of a URI, its query and fragment aside, ends in .json."""
    return F.coalesce(F.lower(F.regexp_replace(uri, r"[?#].*$", "")).endswith(".json"), F.lit(False))


def object_name(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", F.lit("T"), z, x, y)


def material_name(prefix: str, tag: Column, parts: list[Column]) -> Column:
    return F.concat_ws("_", F.lit(prefix), tag, *parts)


def _decoded(v: Column) -> Column:
    return F.coalesce(F.try_url_decode(v), v)


def _encoded(v: Column) -> Column:
    """Form encoding that leaves letters, digits, `_.-~` and turns a blank into `+`."""
    return F.replace(F.replace(F.url_encode(v), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def inherited_query(base: Column, child: Column) -> Column:
    """An absolute child URL with those query parameters of its base that it lacks; blank values don't count."""
    query = lambda u: F.coalesce(F.regexp_extract(u, r"^[^#?]*\?([^#]*)", 1), F.lit(""))
    pairs = lambda q: F.filter(F.split(q, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]*=.+")))
    name = lambda p: _decoded(F.substring_index(p, "=", 1))
    again = lambda p: F.concat(_encoded(name(p)), F.lit("="), _encoded(_decoded(F.regexp_replace(p, "^[^=]*=", ""))))
    have = F.transform(pairs(query(child)), name)
    more = F.array_join(F.transform(F.filter(pairs(query(base)), lambda p: ~F.array_contains(have, name(p))), again), "&")
    head, tail = F.regexp_extract(child, r"^([^#]*)", 1), F.regexp_extract(child, r"(#.*)$", 1)
    joint = F.when(query(child) != "", "&").when(head.endswith("?"), "").otherwise("?")
    return F.when(more == "", child).otherwise(F.concat(head, joint, more, tail))


def absolute(base: Column, uri: Column) -> Column:
    """A reference against an absolute URL, by the rules of RFC 3986: `.` and `..` go, what the reference lacks is the base's."""
    part = lambda v, pattern: F.regexp_extract(v, pattern, 1)
    scheme, server = part(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)"), part(base, r"^[^/?#]*(//[^/?#]*)")
    above, old_query = part(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"), part(base, r"^[^?#]*(\?[^#]*)")
    path, rest = part(uri, r"^([^?#]*)"), part(uri, r"^[^?#]*(.*)$")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(above, "[^/]*$", ""), path))
    full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    steps = F.split(F.substring(full, 2, 1_000_000), "/", -1)
    none = F.array().cast("array<string>")
    clean = F.aggregate(steps, none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    # A path that ends in a dot segment names a folder.
    clean = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(clean, F.array(F.lit("")))).otherwise(clean)
    joined = F.concat(scheme, server, F.lit("/"), F.array_join(clean, "/"), rest)
    same = F.concat(scheme, server, above, F.when(rest.startswith("?"), rest).otherwise(F.concat(old_query, rest)))
    return F.when(uri == "", base).when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), uri).when(uri.startswith("//"), F.concat(scheme, uri)).when(path == "", same).otherwise(joined)


def resolved(base: Column, uri: Column) -> Column:
    """Where a node's content is: its reference against its document's URL, whose query parameters are handed on."""
    return inherited_query(base, absolute(base, uri))


def map_tile_url(base: Column, z: Column, x: Column, y: Column, extension: Column) -> Column:
    """An image of a tile map; y from the bottom."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.concat_ws("/", z, x, y), extension)


def quadkey_tile_url(template: Column, subdomains: Column, z: Column, x: Column, y: Column) -> Column:
    """An image of a quadkey service; y from the bottom.  `n=z` asks for a 404 where there is no image."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int")) - 1 - y
    host = F.element_at(subdomains, (F.pmod(x + top, F.size(subdomains)) + 1).cast("int"))
    url = F.replace(F.replace(template, F.lit("{subdomain}"), host), F.lit("{quadkey}"), quadkey(z.cast("int"), x, top))
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("n=z"))


def first_image(ext: Column) -> Column:
    """Of a tile's files the one to use: .jpg before .png before .tif; others don't count.  An aggregate."""
    rank = F.when(ext == ".jpg", 1).when(ext == ".png", 2).when(ext == ".tif", 3)
    return F.min_by(F.when(rank.isNotNull(), ext), rank)


def cache_path(root: Column, namespace: Column, kind: str, key: list[Column], ext: Column) -> Column:
    """A file's place in a cache: terrain and imagery by z/x/y, composites by their corners, contents by name."""
    name = F.concat_ws("_", *key) if kind == "stitched" else F.concat_ws("/", *key)
    return F.concat(F.concat_ws("/", root, namespace, F.lit(kind), name), ext)
