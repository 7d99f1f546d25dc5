"""Postings from saved result and detail pages of job boards.

A site is a table of selectors; one small matcher of simple selectors walks the parsed page. Lists of
alternatives are tried in turn (``first``) or, joined by commas, in document order (``any``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
JOB = "page_id long, ord int, kind string, title string, company string, location string, description string, url string, platform string"

# Selectors by site.
SITES = {
    "linkedin": {
        "order": "first",
        "card": [".job-card-container", ".jobs-search-results__list-item", ".scaffold-layout__list-item", "li.jobs-search-results__list-item", "li[data-occludable-job-id]", ".job-card-list", "div.job-card-container--clickable"],
        "card_fields": {
            "title": ['a[href*="/jobs/view/"]', ".job-card-list__title", ".job-card-container__link", "a.job-card-list__title--link", "strong"],
            "company": [".job-card-container__primary-description", ".artdeco-entity-lockup__subtitle", ".job-card-container__company-name", "span.job-card-container__primary-description"],
            "location": [".job-card-container__metadata-item", ".artdeco-entity-lockup__caption", ".job-card-container__metadata-wrapper li"],
            "description": [".job-card-list__insight", ".job-card-container__footer-wrapper", '[class*="insight"]'],
        },
        "detail_fields": {
            "description": [".jobs-description__content", ".jobs-description-content__text", ".jobs-box__html-content", "#job-details", '[class*="jobs-description"]', ".jobs-unified-description__content", 'article[class*="jobs"]'],
            "title": [".job-details-jobs-unified-top-card__job-title", ".jobs-unified-top-card__job-title", 'h1[class*="job-title"]', ".t-24.job-details-jobs-unified-top-card__job-title", 'h1 a[href*="/jobs/view/"]', 'h2[class*="job-title"]'],
            "company": [".job-details-jobs-unified-top-card__company-name", ".jobs-unified-top-card__company-name", 'span[class*="company-name"]', 'a[href*="/company/"]'],
            "location": [".job-details-jobs-unified-top-card__bullet", ".jobs-unified-top-card__bullet", 'span[class*="workplace-type"]', ".job-details-jobs-unified-top-card__primary-description-container span"],
        },
        "least": 10,
        "canonical": True,
        "scan_only_description": True,
    },
    "indeed": {
        "order": "any",
        "card": [".job_seen_beacon", ".jobsearch-ResultsList .result", ".tapItem"],
        "card_fields": {
            "title": ["h2.jobTitle a", ".jobTitle > a", "a.jcs-JobTitle"],
            "company": ['[data-testid="company-name"]', ".companyName", ".company"],
            "location": ['[data-testid="text-location"]', ".companyLocation", ".location"],
            "description": [".job-snippet", ".underShelfFooter", ".heading6"],
        },
        "detail_fields": {
            "description": ["#jobDescriptionText", ".jobsearch-jobDescriptionText", ".jobsearch-JobComponent-description"],
            "title": [".jobsearch-JobInfoHeader-title", 'h1[data-testid="jobsearch-JobInfoHeader-title"]'],
            "company": ['[data-testid="inlineHeader-companyName"]', ".jobsearch-InlineCompanyRating-companyHeader"],
            "location": ['[data-testid="inlineHeader-companyLocation"]', ".jobsearch-JobInfoHeader-subtitle > div:nth-child(2)"],
        },
        "least": 0,
    },
    "glassdoor": {
        "order": "any",
        "card": [".react-job-listing", '[data-test="jobListing"]', ".JobsList_jobListItem__wjTHv", "li[data-jobid]"],
        "card_fields": {
            "title": [".job-title", '[data-test="job-title"]', "a.JobCard_jobTitle__GLyJ1"],
            "company": [".job-search-key-l2wjgv", '[data-test="emp-name"]', ".EmployerProfile_employerName__PhWJI"],
            "location": [".job-search-key-1rdszc", '[data-test="emp-location"]', ".JobCard_location__N_iYE"],
        },
        "detail_fields": {
            "description": [".jobDescriptionContent", '[data-test="jobDescriptionContent"]', ".JobDetails_jobDescription__uW_fK"],
            "title": ['[data-test="job-title"]', ".JobDetails_jobTitle__t4VJM", "h1.heading_Heading__BqX5J"],
            "company": ['[data-test="employerName"]', ".JobDetails_companyName__mSHBY", ".EmployerProfile_employerName__PhWJI"],
            "location": ['[data-test="location"]', ".JobDetails_location__MbnkO"],
        },
        "least": 0,
    },
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "classes")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = frozenset(attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r'#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]|:nth-child\((\d+)\)|([a-zA-Z][\w]*)')


@cache
def _steps(selector: str) -> tuple[tuple[bool, tuple], ...]:
    """A selector read once: for each step whether it must be the parent of the next, and its parts."""
    return tuple((step.startswith(">"), tuple(_PART.findall(step.lstrip(">")))) for step in selector.replace(" > ", " >").split(" "))


def _is(node: Node, parts: tuple) -> bool:
    for by_id, by_class, attr, test, value, nth, tag in parts:
        if by_id and node.attrs.get("id") != by_id or by_class and by_class not in node.classes or tag and node.tag != tag.lower():
            return False
        if attr and (attr not in node.attrs or test == "=" and node.attrs[attr] != value or test == "*=" and value not in node.attrs[attr]):
            return False
        if nth and (node.parent is None or [c for c in node.parent.children if isinstance(c, Node)].index(node) + 1 != int(nth)):
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether a node matches a selector of simple ones joined by a space or ``>``."""
    *above, (direct, last) = _steps(selector)
    if not _is(node, last):
        return False
    up = node.parent
    for child, parts in reversed(above):
        while up is not None and up.tag and not _is(up, parts):
            if direct:
                return False
            up = up.parent
        if up is None or not up.tag:
            return False
        direct, up = child, up.parent
    return True


def find_all(root: Node, fields: dict[str, list[str]], order: str) -> dict[str, Node | None]:
    """The node of each field, in one walk: by the first of its selectors that any node matches (``first``), or
    the first node that matches any (``any``)."""
    best: dict[str, tuple[int, Node]] = {}
    for node in root.walk():
        for field, selectors in fields.items():
            rank = best[field][0] if field in best else len(selectors)
            if rank == 0 or field in best and order == "any":
                continue
            found = next((i for i, s in enumerate(selectors[:rank]) if matches(node, s)), None)
            if found is not None:
                best[field] = (found, node)
    return {f: best[f][1] if f in best else None for f in fields}


def _link(node: Node, card: Node, base: str, order: str) -> str | None:
    while node is not None and not (node.tag == "a" and node.attrs.get("href")):
        node = node.parent
    if node is None and order == "first":
        node = next((n for n in card.walk() if n.tag == "a" and n.attrs.get("href")), None)
    return urljoin(base, node.attrs["href"]) if node is not None else None


def cards(root: Node, site: str, base: str, scan: bool = False) -> list[dict]:
    """Postings of a result page: those with a title and a URL not seen before on the page."""
    spec, seen, out = SITES[site], set(), []
    for card in (n for n in root.walk() if any(matches(n, s) for s in spec["card"])):
        nodes = find_all(card, spec["card_fields"], spec["order"])
        if spec.get("scan_only_description") and not scan:
            nodes["description"] = None
        title = nodes["title"].text() if nodes["title"] else None
        url = _link(nodes["title"], card, base, spec["order"]) if nodes["title"] or spec["order"] == "first" else None
        if title and url and url not in seen:
            seen.add(url)
            job = {f: n.text() if n else None for f, n in nodes.items()}
            if "description" in nodes:
                job["description"] = job["description"] or ""
            out.append(job | {"url": url})
    return out


def detail(root: Node, site: str, base: str) -> dict | None:
    """The posting of a detail page; none without a description of the site's least length."""
    spec = SITES[site]
    nodes = find_all(root, spec["detail_fields"], spec["order"])
    if nodes["description"] is None or len(nodes["description"].text()) < spec["least"]:
        return None
    url = base
    if spec.get("canonical"):
        link = next((n for n in root.walk() if n.tag == "link" and n.attrs.get("rel") == "canonical" and n.attrs.get("href")), None)
        url = urljoin(base, link.attrs["href"]) if link else base
    return {f: n.text() if n else "" for f, n in nodes.items()} | {"url": url}


def extract(pages: DataFrame, site: str, scan: bool = False, keep: str | None = None) -> DataFrame:
    """Postings of pages (page_id, url, html): each page's detail, if it has one, then its cards, in
    order. Pages are parsed where they are read; a null page has none. ``keep``: a column of the pages that
    their postings keep."""
    kept = [keep] if keep else []
    schema = JOB + "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, html, *own in zip(*(batch[c] for c in ("page_id", "url", "html", *kept))):
                root, base = parse(html), url or ""
                one = detail(root, site, base)
                found = [("detail", one)] * (one is not None) + [("card", c) for c in cards(root, site, base, scan)]
                rows += [{"page_id": page_id, "ord": i, "kind": kind, "platform": site, "description": None} | dict(zip(kept, own)) | job for i, (kind, job) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in JOB.split(", ")), *kept])

    return pages.select("page_id", "url", "html", *kept).mapInPandas(run, schema)


def first_time(postings: DataFrame, order: list[str], session: str | None = None) -> DataFrame:
    """Postings seen for the first time in a session: details and cards have keys of their own; a detail
    is known by its URL, or its title without one. With a column ``enriched`` details sent once more after
    a page has changed (where it is true) have keys of their own, too."""
    key = F.when(F.col("kind") == "card", F.col("url")).otherwise(F.coalesce(F.nullif("url", F.lit("")), F.col("title")))
    space = F.when((F.col("kind") == "detail") & F.coalesce("enriched", F.lit(False)), "enriched").otherwise(F.col("kind")) if "enriched" in postings.columns else F.col("kind")
    own = F.struct(*postings.columns)
    by = [session] if session else []
    return postings.withColumns({"_space": space, "_key": key}).groupBy(*by, "_space", "_key").agg(F.min_by(own, F.struct(*order)).alias("p")).select("p.*")


def scan_passes(passes: DataFrame, site: str) -> DataFrame:
    """Postings of a scheduled scan: ``passes`` (page_id, pass, url, html) are snapshots of one page while it
    loads; each posting comes from the first that shows it, in the order of passes, details first."""
    return first_time(extract(passes, site, scan=True, keep="pass"), ["pass", "ord"], "page_id")
