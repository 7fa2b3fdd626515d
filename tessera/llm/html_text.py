"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of tags and text nodes. Words score positive, tags
negative; one linear scan finds the contiguous region of the highest sum.

What a word scores depends on the containers that it stands in. A container has a
weight by its element and the words of its class, id, role or label: log odds of
holding main text, learned from labelled pages, on top of a prior for words whose
meaning is known. From the inside out, weights add up until a container with
strong evidence (STRONG or more, either way) decides. Words whose weight is
positive count, each with it, and are the text of the region; a text node of
negative weight counts as one word against and is left out. Labelled pages are those whose markup
names the content itself with ``article`` or ``main``; there, text that stands in
nothing has a learned weight of its own, and elsewhere it is content, so that the
scan alone finds what menus of links and the like leave.

Tags cost by their name, as much more as they are likelier outside of main text.
What they cost against words is learned too: of SCALES the one by which the scan
finds the main text of labelled pages best when it may not see what names it.

Unclosed tags, comments and scripts end with the page; text of a page without
any word is ''. Null html gives ''; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches

#: The classifier is fitted on at most so many labelled pages (the first that the driver meets, no random sample), and the scale of tags on so many of them.
FIT_PAGES = 500
SCALE_PAGES = 100
#: Evidence that decides, whatever stands around it.
STRONG = 3.0
#: What a tag may cost, in words of no evidence; of equally good ones the first is taken.
SCALES = (0.2, 0.1, 0.4, 0.05, 0.02)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<dark>script|style|noscript|template|iframe|svg|object|head|textarea|select|button)\b(?:[^'\">]++|\"[^\"<]*+\"|'[^'<]*+')*+>.*?(?:</(?P=dark)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:(?:[^'\">]++|\"[^\"<]*+\"|'[^'<]*+')*+(?=>|\Z)|[^>]*+))(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKS = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

# Elements that break blocks or hold others, and what elements and words of class, id or role say before anything is learned.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table td th tr li fieldset dialog details menu figure blockquote center body".split())
CONTENT = ("article", "main")
ELEMENTS = {"article": 5.0, "main": 5.0, "nav": -5.0, "menu": -5.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "fieldset": -5.0, "dialog": -5.0, "header": -2.5}
STRONG_WORDS = """nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc masthead topbar banner footer sidebar widget promo ad ads adv advert advertisement adsense sponsor
    sponsored sponsorship cookie cookies consent gdpr popup modal newsletter subscribe subscription paywall signup login comment comments commentlist respond disqus replies share sharing social""".split()
WEAK_WORDS = "header tabs skip copyright colophon legal aside related recommended trending popular rail notice overlay alert disclaimer reply discussion form search".split()
WORDS = dict.fromkeys(STRONG_WORDS, -5.0) | dict.fromkeys(WEAK_WORDS, -2.0)
PLAIN, NAMED = "plain", "plain of a labelled page"
PRIORS = {PLAIN: 1.0, NAMED: -1.0}


def marks(rest: str) -> list[str]:
    """The names that a tag's class, id, role and label give, each as a feature."""
    return [f".{token.lower()}" for m in MARKS.finditer(rest) for token in (m[1] or m[2] or m[3] or "").split()]


@lru_cache(maxsize=1 << 14)
def prior(feature: str) -> float:
    """Of a name: the strongest of its words that are strong by themselves, else the mean of all."""
    if not feature.startswith("."):
        return PRIORS.get(feature, ELEMENTS.get(feature, 0.0))
    said = [WORDS.get(w.lower(), 0.0) for w in SPLIT.split(feature[1:]) if w]
    return min(said) if said and min(said) <= -STRONG else sum(said) / len(said) if said else 0.0


@dataclass(frozen=True)
class Weights:
    """By feature, what is learned on top of its prior; by tag, how much likelier it is outside; the scale of tags."""

    learned: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)
    scale: float = SCALES[0]

    def of(self, feature: str) -> float:
        return prior(feature) + self.learned.get(feature, 0.0)

    def of_container(self, name: str, names: list[str], content: bool) -> float:
        """content: whether elements that name the content may speak."""
        element = 0.0 if name in CONTENT and not content else self.of(name)
        said = min((self.of(f) for f in names), default=0.0)
        return said if said <= -STRONG else element + said

    def of_tag(self, name: str) -> float:
        return -self.scale * (1 + max(0.0, self.tags.get(name, 0.0)))


def events(page: str):
    """(kind, value, names) in page order: 'text' with a text, 'open', 'close' and 'tag' with a tag's name. The
    names are those of a container that is opened; closing tags close what they name and what is open within."""
    open_: list[str] = []
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], None
        at = m.end()
        if (dark := m["dark"]) is not None:
            yield "tag", dark.lower(), None
            continue
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if name not in CONTAINERS:
            yield "tag", name, None
        elif m["end"]:
            if name in open_:
                while True:
                    last = open_.pop()
                    yield "close", last, None
                    if last == name:
                        break
        elif m["rest"].endswith("/"):
            yield "tag", name, None
        else:
            if name in ("li", "td", "th", "tr") and open_ and open_[-1] == name:
                yield "close", open_.pop(), None
            open_.append(name)
            yield "open", name, marks(m["rest"]) if m["rest"] and name not in ("body", "html") else []
    if at < len(page):
        yield "text", page[at:], None


def names_content(page: str | None) -> bool:
    return bool(page) and any(kind == "open" and name in CONTENT for kind, name, _ in events(page))


def nodes(page: str, weights: Weights, named: bool, content: bool = True):
    """(kind, value, score) of text nodes (the score is that of a word there) and tags."""
    score = weights.of(NAMED if named and content else PLAIN)
    stack: list[tuple[float, bool]] = []
    shut = False  # within something that leaves no content, but for a form, which may hold a whole page
    for kind, value, names in events(page):
        if kind == "text":
            yield kind, value, score
            continue
        if kind == "open":
            stack.append((score, shut))
            own = weights.of_container(value, names, content and not shut)
            score = own if abs(own) >= STRONG else score + own
            shut = shut or own <= -STRONG and value not in ("form", "body")
        elif kind == "close" and stack:
            score, shut = stack.pop()
        yield "tag", value, weights.of_tag(value)


def labelled_counts(page: str | None) -> Counter:
    """Words and tags by (kind, feature, inside) of a page that names its content; nothing for another page.

    Inside is what stands in the named content and in nothing there whose prior is against it. A text counts for
    the container whose prior says most about it, or else for the names of the innermost that has any."""
    found: Counter = Counter()
    if not names_content(page):
        return found
    blank = Weights()
    stack: list[tuple[str, list[str], float]] = []
    inside_words = 0
    scored = nodes(page, blank, True)
    for (kind, value, names), (_, _, score) in zip(events(page), scored):
        if kind == "open":
            stack.append((value, names, blank.of_container(value, names, True)))
        elif kind == "close" and stack:
            stack.pop()
        inside = score > 0 if kind == "text" else any(n in CONTENT for n, _, _ in stack)
        if kind == "text":
            if n := len(value.split()):
                telling = max(stack, key=lambda c: abs(c[2]), default=None)
                if telling is None or not telling[2]:
                    telling = next((c for c in reversed(stack) if c[1]), None)
                features = [NAMED] if telling is None else telling[1] or [telling[0]]
                inside_words += n * inside
                for f in set(features):
                    found["word", f, inside] += n
                found["words", "", inside] += n
        else:
            found["tag", value, inside] += 1
            found["tags", "", inside] += 1
    return found if inside_words else Counter()


def fit(counts: dict) -> Weights:
    """Log odds of inside, with one added to each count."""

    def odds(kind: str, feature: str) -> float:
        return math.log((counts.get((kind, feature, True), 0) + 1) / (counts.get((kind, feature, False), 0) + 1))

    out = {}
    for kind in ("word", "tag"):
        base = odds(f"{kind}s", "")
        out[kind] = {f: (odds(kind, f) - base) * (1 if kind == "word" else -1) for k, f, _ in counts if k == kind}
    return Weights(out["word"], out["tag"])


def region(scored: list) -> tuple[int, int]:
    """The contiguous nodes of the highest sum; of equal ones the first. Text that is left out counts as one word
    against, whatever its length: it mustn't cut the region in two."""
    best, best_from, best_to, run, start = 0.0, 0, 0, 0.0, 0
    for k, (kind, value, score) in enumerate(scored):
        if run <= 0:
            run, start = 0.0, k
        if kind == "text":
            n = len(value.split())
            score = score * n if score > 0 else max(score, -1.0) if n else 0.0
        run += score
        if run > best:
            best, best_from, best_to = run, start, k + 1
    return best_from, best_to


def extract(page: str | None, weights: Weights, content: bool = True, scan: bool = True) -> str:
    """content: whether elements that name the content may speak; scan: whether only the region counts."""
    if not page:
        return ""
    scored = list(nodes(page, weights, content and names_content(page), content))
    low, high = region(scored) if scan else (0, len(scored))
    parts = []
    for kind, value, score in scored[low:high]:
        if kind == "text":
            if score > 0:
                parts.append(value)
        elif value not in INLINE:
            parts.append(" ")
    return " ".join(entities.unescape("".join(parts)).split())


def agreement(found: str, wanted: str) -> float:
    """F1 of the words, repeats counted."""
    a, b = Counter(found.split()), Counter(wanted.split())
    both = 2 * (a & b).total()
    return both / (a.total() + b.total()) if both else float(not a and not b)


def fit_pages(pages: list[str]) -> Weights:
    """Weights of labelled pages; then the scale of tags by which pages whose names are hidden come out best."""
    total: Counter = Counter()
    for page in pages:
        total.update(labelled_counts(page))
    weights = fit(total)
    wanted = [(page, extract(page, weights)) for page in pages[:SCALE_PAGES]]

    def quality(scale: float) -> float:
        trial = replace(weights, scale=scale)
        return sum(agreement(extract(page, trial, content=False), text) for page, text in wanted)

    return replace(weights, scale=max(SCALES, key=quality)) if wanted else weights


def learn(pages: DataFrame, html: str = "html", limit: int = FIT_PAGES) -> Weights:
    """Weights from at most ``limit`` pages, which the driver reads from the first partitions that have them."""
    return fit_pages([p[0] for p in pages.select(html).where(F.col(html).rlike("(?i)<(article|main)[ >]")).take(limit)])


def main_text(pages: DataFrame, weights: Weights, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page in place of its html."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, text)]

    def run(batches):
        for batch in batches:
            found = [extract(page.as_py(), weights) for page in batch.column(html)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {text: pa.array(found, pa.string())})

    schema = T.StructType([pages.schema[c] for c in kept]).add(text, "string")
    return pages.select(*kept, html).mapInArrow(run, schema)
