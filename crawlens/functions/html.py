"""Page facts from HTML: one parse per page gives a struct with everything; helpers turn its arrays into tables.

Parsing needs a tag stack, which column expressions lack, so it is an Arrow UDF over Python's own HTML parser. A page
that cannot be parsed to its end gives what was found before. Null pages give null.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.functions.url import join, normalize

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
STRUCTURAL = frozenset(("form", "nav", "aside", "footer", "header"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SKIPPED_HREFS = ("javascript:", "mailto:", "tel:", "data:", "#")
# Parts of ids and classes of consent banners and chat widgets.
BANNERS = (
    "cookie-consent", "cookie-banner", "cookie-notice", "cookie-bar", "cookie-popup", "cookie-modal", "cookie-wall",
    "cookie-law", "cookie-policy", "cookie-message", "cookie-alert", "cookie-overlay", "cookieconsent", "cookiebanner",
    "cookienotice", "cookiebar", "cookies-eu", "cookies-modal", "cookies-overlay", "gdpr-banner", "gdpr-notice",
    "gdpr-popup", "gdpr-overlay", "gdpr-consent", "consent-banner", "consent-modal", "consent-popup", "consent-overlay",
    "privacy-banner", "privacy-notice", "privacy-popup", "chat-widget", "livechat",
)
# Parts of ids and classes of promotional blocks.
PROMOS = (
    "newsletter", "carousel", "cross-sell", "crosssell", "crossselling", "upsell", "up-sell", "related-product",
    "relatedproduct", "related-post", "relatedpost", "recently-viewed", "recentlyviewed", "product-recommend",
    "recommended-product", "subscribe", "subscription", "suscripcion", "suscribete", "signup", "sign-up",
    "social-share", "share-button", "sharing-button", "advertisement", "adsense", "disqus", "wishlist", "lightbox",
)
# Phrases that mark short promotional or legal blocks, and the length up to which a block is short.
PHRASES = (
    "aceptar cookies", "accept cookies", "utilizamos cookies", "we use cookies", "política de cookies", "cookie policy",
    "suscríbete", "suscribete", "subscribe to", "join our newsletter", "síguenos en", "siguenos en", "follow us on",
    "compartir en", "share on", "todos los derechos reservados", "all rights reserved",
)
SHORT = 400
PHRASE_TAGS = frozenset(("div", "section", "p", "span", "li", "a", "button"))
# Ids and classes of consent and chat libraries.
WIDGETS = frozenset([
    "#CybotCookiebotDialog", "#CybotCookiebotDialogBodyUnderlay", "#onetrust-banner-sdk", "#onetrust-consent-sdk", ".osano-cm-window", ".cc-window", ".cc-banner", ".cc-revoke",
    "#tarteaucitronRoot", "#usercentrics-root", "#sp-consent-message", "#ez-cookie-dialog", "#catapult-cookie-bar", "#moove_gdpr_cookie_info_bar",
    "#hubspot-messages-iframe-container", "#intercom-container", "#intercom-frame", "#crisp-chatbox", "#drift-widget-container", "#drift-frame-chat", "#tawk-bubble-container",
])

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


META = _struct(
    title=_S, meta_description=_S, meta_keywords=_S, meta_robots=_S, canonical_href=_S, og_title=_S, og_description=_S,
    og_image=_S, og_url=_S, og_type=_S, twitter_card=_S, twitter_title=_S, twitter_description=_S, rel_next=_S, rel_prev=_S,
    meta_refresh=_S, has_meta_outside_head=_B,
)
LINK = _struct(url=_S, anchor_text=_S, rel=_S, link_position=_S, target=_S, alt_text=_S, follow=_B, link_type=_S)
RESOURCE = _struct(url=_S, resource_type=_S, alt_text=_S, width=_I, height=_I, is_mixed_content=_B)
PAGE = _struct(
    meta=META,
    headings=T.ArrayType(_struct(tag=_S, position=_I, text=_S)),
    links=T.ArrayType(LINK),
    hreflang=T.ArrayType(_struct(lang=_S, href=_S)),
    structured_data=T.ArrayType(_struct(raw=_S, format=_S, schema_type=_S)),
    resources=T.ArrayType(RESOURCE),
    mixed_content=T.ArrayType(_S),
    word_count=_I,
    visible_length=_I,
    text_ratio=T.DoubleType(),
    main_text=_S,
    main_markdown=_S,
    has_unsafe_crossorigin=_B,
)


def clean(text: str | None) -> str | None:
    return (re.sub(r"\s+", " ", text).strip() or None) if text else None


def parse_int(value: str | None) -> int | None:
    try:
        return int((value or "").strip().rstrip("px%").strip())
    except ValueError:
        return None


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This element, then its descendants in document order; no recursion, pages nest deeply."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack += reversed(node.children)

    def elements(self, *tags: str):
        return (n for n in self.walk() if isinstance(n, Node) and (not tags or n.tag in tags))

    def above(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self, skip: frozenset[str] = frozenset()) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or node.tag not in skip:
                stack += reversed(node.children)
        return out


class Tree(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        try:
            self.feed(source)
            self.close()
        except (AssertionError, ValueError):
            pass  # malformed to the end: what stands before counts

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        if tag in ("p", "li", "td", "tr", "option") and self.at.tag == tag:
            self.at = node.parent = self.at.parent or self.root
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def link_position(a: Node) -> str:
    """The nearest ancestor that is, or by class or id looks like, navigation, footer, header or sidebar."""
    for n in a.above():
        if n.tag in ("nav", "footer", "header"):
            return n.tag
        if n.tag == "aside":
            return "sidebar"
        hint = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        for word in ("nav", "footer", "header", "sidebar"):
            if word in hint:
                return word
    return "content"


def _meta(root: Node, base: str | None) -> dict:
    named: dict[str, list[str]] = {}
    for m in root.elements("meta"):
        for key in {m.attrs.get("name", "").lower(), m.attrs.get("property", "").lower()} - {""}:
            if value := clean(m.attrs.get("content")):
                named.setdefault(key, []).append(value)
    first = lambda k: named.get(k, [None])[0]
    rels: dict[str, str | None] = {}
    for n in root.elements("link"):
        if "href" in n.attrs:
            rels.setdefault(n.attrs.get("rel", ""), clean(n.attrs["href"]))
    title = next((t for t in root.elements("title") if all(x.tag != "svg" for x in t.above())), None)
    refresh = next((m.attrs.get("content") for m in root.elements("meta") if m.attrs.get("http-equiv", "").lower() == "refresh"), None)
    heads = {id(x) for h in root.elements("head") for x in h.elements("meta", "title")}
    return {
        "title": clean(" ".join(title.text())) if title else None,
        "meta_description": first("description"),
        "meta_keywords": first("keywords"),
        "meta_robots": ", ".join(named.get("robots", [])) or None,
        "canonical_href": join(base, rels.get("canonical")),
        **{k.replace(":", "_"): first(k) for k in ("og:title", "og:description", "og:type", "twitter:card", "twitter:title", "twitter:description")},
        "og_image": join(base, first("og:image")),
        "og_url": join(base, first("og:url")),
        "rel_next": join(base, rels.get("next")),
        "rel_prev": join(base, rels.get("prev")),
        "meta_refresh": clean(refresh),
        "has_meta_outside_head": any(id(m) not in heads for m in root.elements("meta")),
    }


def _links(root: Node, base: str, nofollow: bool) -> list[dict]:
    out = []
    for a in root.elements("a", "area"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith(SKIPPED_HREFS):
            continue
        images = list(a.elements("img"))
        text = clean(a.attrs.get("alt")) if a.tag == "area" else clean(" ".join(a.text()))
        rel = clean(a.attrs.get("rel"))
        out.append(
            {
                "url": normalize(join(base, href) or href),
                "anchor_text": text,
                "rel": rel,
                "link_position": link_position(a),
                "target": clean(a.attrs.get("target")),
                "alt_text": clean(" ".join(i.attrs.get("alt", "").strip() for i in images)),
                "follow": not nofollow and "nofollow" not in (rel or "").lower().split(),
                "link_type": "hyperlink" if not images else "image_text" if text else "image",
            }
        )
    return out


def _resources(root: Node, base: str) -> list[dict]:
    seen: set[str] = set()
    out = []

    def add(raw: str, kind: str, n: Node | None = None) -> None:
        if not raw.strip():
            return
        absolute = join(base, raw.strip()) or raw
        url = normalize(absolute)
        if url in seen:
            return
        seen.add(url)
        alt = n.attrs.get("alt") if n else None  # an empty one marks decoration, none at all is a fault
        out.append({"url": url, "resource_type": kind, "alt_text": "" if alt is not None and not alt.strip() else clean(alt), "width": parse_int(n.attrs.get("width")) if n else None, "height": parse_int(n.attrs.get("height")) if n else None, "is_mixed_content": base.startswith("https://") and absolute.startswith("http://")})

    for n in root.elements("img"):
        add(n.attrs.get("src", ""), "image", n)
    for n in root.elements("link"):
        if n.attrs.get("rel") == "stylesheet":
            add(n.attrs.get("href", ""), "css")
    for n in root.elements("script"):
        add(n.attrs.get("src", ""), "js")
    for n in root.elements():
        if first := n.attrs.get("srcset", "").split(",")[0].split():
            add(first[0], "image", n)
    return out


def _mixed(root: Node, url: str) -> list[str]:
    if urlsplit(url).scheme != "https":
        return []
    refs = [n.attrs.get("src", "") for tag in ("img", "script") for n in root.elements(tag)]
    refs += [n.attrs.get("href", "") for n in root.elements("link") if n.attrs.get("rel") == "stylesheet"]
    refs += [n.attrs.get("src", "") for n in root.elements("iframe")]
    absolute = dict.fromkeys(join(url, r.strip()) for r in refs if r.strip())
    return [a for a in absolute if a and a.startswith("http:")]


def _types(item) -> str | None:
    t = item.get("@type") if isinstance(item, dict) else None
    return ", ".join(map(str, t)) if isinstance(t, list) else None if t is None else str(t)


def _microdata(node: Node) -> dict:
    kind = node.attrs.get("itemtype", "").rstrip("/").rsplit("/", 1)[-1]
    item: dict = {"@type": kind} if kind else {}
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        if prop := n.attrs.get("itemprop"):
            value = _microdata(n) if "itemscope" in n.attrs else next((n.attrs[a] for a in ("content", "href", "src", "datetime") if a in n.attrs), clean(" ".join(n.text())))
            item.setdefault(prop, value)
        if "itemscope" not in n.attrs:
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return item


def _structured(root: Node) -> list[dict]:
    out = []
    for n in root.elements("script"):
        if n.attrs.get("type", "").lower().strip() == "application/ld+json":
            try:
                data = json.loads("".join(n.text()))
            except ValueError:
                continue
            out += [(x, "jsonld") for x in (data if isinstance(data, list) else [data])]
    for n in root.elements():
        if "itemscope" in n.attrs and "itemprop" not in n.attrs:
            out.append((_microdata(n), "microdata"))
        if n.attrs.get("typeof"):  # RDFa without a type is left
            item: dict = {"@type": n.attrs["typeof"].split()[0].rsplit(":", 1)[-1]}
            for x in n.elements():
                if p := x.attrs.get("property"):
                    item.setdefault(p.rsplit(":", 1)[-1], x.attrs.get("content") or clean(" ".join(x.text())))
            out.append((item, "rdfa"))
    return [{"raw": json.dumps(x, ensure_ascii=False), "format": f, "schema_type": _types(x)} for x, f in out]


def strip_boilerplate(root: Node, promos: bool = True, extra: frozenset[str] = frozenset()) -> Node:
    """Cuts banners, widgets, dialogs, structural elements and short promotional blocks out of the tree. `extra` names
    more of them as #id, .class or tag."""
    parts = BANNERS + (PROMOS if promos else ())
    chosen = WIDGETS | extra

    def goes(n: Node) -> bool:
        ident, classes = n.attrs.get("id", ""), n.attrs.get("class", "")
        if n.tag in STRUCTURAL or n.tag == "dialog" or n.attrs.get("aria-modal") == "true":
            return True
        if n.tag in chosen or f"#{ident}" in chosen or any(f".{c}" in chosen for c in classes.split()):
            return True
        if (ident or classes) and any(p in ident.lower() or p in classes.lower() for p in parts):
            return True
        if promos and n.tag in PHRASE_TAGS:
            text = "".join(n.text())
            return 0 < len(text) <= SHORT and any(p in text.lower() for p in PHRASES)
        return False

    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]
        stack += [c for c in node.children if isinstance(c, Node)]
    return root


BLOCKS = HEADINGS | frozenset("p div li section article blockquote pre tr ul ol table br".split())


def main_content(root: Node) -> tuple[str | None, str | None]:
    """Text and Markdown of the main container: main, article or role=main, else the body, without boilerplate."""
    pick = next(root.elements("main"), None) or next(root.elements("article"), None)
    pick = pick or next((n for n in root.elements() if n.attrs.get("role") == "main"), None) or next(root.elements("body"), None)
    if pick is None:
        return None, None
    text: list[str] = []
    marked: list[str] = []
    stack: list = [pick]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            text.append(n)
            marked.append(re.sub(r"\s+", " ", n))
        elif isinstance(n, tuple):
            marked.append(n[0])
        elif n.tag not in HIDDEN:
            open_, close = "", ""
            if n.tag in HEADINGS:
                open_, close = "\n\n" + "#" * int(n.tag[1]) + " ", "\n\n"
            elif n.tag == "li":
                open_ = "\n- "
            elif n.tag in BLOCKS:
                open_, close = "\n\n", "\n\n"
            elif n.tag in ("strong", "b"):
                open_ = close = "**"
            elif n.tag in ("em", "i"):
                open_ = close = "_"
            elif n.tag == "a" and n.attrs.get("href"):
                open_, close = "[", f"]({n.attrs['href']})"
            elif n.tag == "img" and n.attrs.get("src"):
                open_ = f"![{n.attrs.get('alt', '')}]({n.attrs['src']})"
            if n.tag in BLOCKS:
                text.append("\n")
            marked.append(open_)
            stack.append((close,))
            stack += reversed(n.children)
    plain = re.sub(r"\n{2,}", "\n", "\n".join(filter(None, (clean(x) for x in "".join(text).split("\n")))))
    md = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(marked))).strip()
    return plain or None, md or None


def parse_page(html: str, url: str | None = None, x_robots: str | None = None) -> dict:
    """Everything about a page as a dict of the fields of PAGE."""
    root = Tree(html).root
    page = url or ""
    base_tag = next((n.attrs["href"] for n in root.elements("base") if n.attrs.get("href", "").strip()), None)
    base = join(page, base_tag.strip()) if base_tag else page
    meta = _meta(root, base or None)
    directives = {t for v in (meta["meta_robots"], x_robots) for t in re.split(r"[,\s]+", (v or "").lower())}
    links = _links(root, base or "", bool(directives & {"nofollow", "none"}))
    headings = [h for h in root.elements(*HEADINGS) if not any(x.tag in ("template", "noscript", "svg") for x in h.above())]
    body = next(root.elements("body"), None)
    pieces = body.text(HIDDEN) if body else []
    visible = len(" ".join(pieces))
    unsafe = any(k["target"] == "_blank" and not {"noopener", "noreferrer"} & set((k["rel"] or "").lower().split()) for k in links)
    found = {
        "meta": meta,
        "headings": [{"tag": h.tag, "position": i, "text": clean(" ".join(h.text()))} for i, h in enumerate(headings)],
        "links": links,
        "hreflang": [{"lang": lang, "href": href} for n in root.elements("link") if n.attrs.get("rel") == "alternate" for lang, href in ((clean(n.attrs.get("hreflang")), join(base or None, clean(n.attrs.get("href")))),) if lang and href],
        "structured_data": _structured(root),
        "resources": _resources(root, base or ""),
        "mixed_content": _mixed(root, page),
        "word_count": sum(len(p.split()) for p in pieces),
        "visible_length": visible,
        "text_ratio": round(visible / len(html) * 100, 2) if html else 0.0,
        "has_unsafe_crossorigin": unsafe,
    }
    text, md = main_content(strip_boilerplate(root))
    return found | {"main_text": text, "main_markdown": md}



@F.arrow_udf(PAGE)
def page_facts(html: pa.Array, url: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = [None if h is None else parse_page(h, u) for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)]
    return pa.array(rows, to_arrow_type(PAGE))


def facts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with the struct column `page`."""
    return pages.withColumn("page", page_facts(F.col(html), F.col(url)))


def rows_of(parsed: DataFrame, key: str, part: str) -> DataFrame:
    """One row for each element of an array of the page struct (links, headings, hreflang, resources, structured_data)."""
    return parsed.select(key, F.explode(f"page.{part}").alias("x")).select(key, "x.*")


def security_headers(headers: Column | str) -> Column:
    """Flags of a map of response headers, names in any case."""
    h = F.transform_keys(F.col(headers) if isinstance(headers, str) else headers, lambda k, _: F.lower(k))
    has = lambda name: F.map_contains_key(h, name)
    return F.struct(has("strict-transport-security").alias("has_hsts"), has("content-security-policy").alias("has_csp"), has("x-content-type-options").alias("has_x_content_type_options"), has("x-frame-options").alias("has_x_frame_options"), F.nullif(F.try_element_at(h, F.lit("referrer-policy")), F.lit("")).alias("referrer_policy"))
