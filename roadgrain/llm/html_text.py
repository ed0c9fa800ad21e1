"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. Each block is a vector of its
hashed tag path and words and of a few shape numbers; a bidirectional LSTM in
numpy reads the whole sequence and labels every block as main text or not. The
labeller is trained here: pages are composed from known parts (articles, menus,
notices, comments and so on, in many markups) around words of a bounded sample
of the table's pages, so every block's label is known.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages whose words the training pages are made of, and the training pages.
SAMPLE_PAGES, TRAIN_PAGES, EPOCHS, SEED = 200, 480, 10, 5
PATH_DIM, LEAF_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 256, 32, 32, 8, 20
DIM = PATH_DIM + LEAF_DIM + WORD_DIM + SHAPE_DIM

# fixed values: HTML element names
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = "script style title noscript template textarea svg iframe object".split()
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # an element that closes itself is empty; one that never closes ends at its tag, scripts and styles apart
    rf"|<({'|'.join(HIDDEN_TEXT)})\b(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?<!/)>.*?</\1\s*>"
    r"|<(?:script|style)\b(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?<!/)>.*\Z"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|(<?[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """A run of text that no block-level tag divides. path: hashes of the open elements'
    tags and name parts; leaf: the innermost element's tag."""

    text: str
    path: tuple[int, ...]
    leaf: str
    linked: int
    depth: int


@lru_cache(maxsize=20000)
def _slots(tag: str, attributes: str) -> tuple[int, ...]:
    names = {tag}
    for m in _NAMES.finditer(attributes):
        names.update("." + p.lower() for p in _PARTS.findall(m[2] or m[3] or m[4] or ""))
    return tuple(zlib.crc32(x.encode()) % PATH_DIM for x in sorted(names))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                outer = [s for s in stack if s[0] not in INLINE]
                path = {h for _, slots in outer for h in slots}
                out.append(Block(body, tuple(path), outer[-1][0] if outer else "", min(linked, len(body)), len(outer)))
            text.clear()
        linked = 0

    for m in _SCAN.finditer(page):
        if m[5] is not None:
            text.append(m[5])
            if links:
                linked += len(m[5])
        elif m[3] is not None:
            tag = m[3].lower()
            if tag not in INLINE:
                flush()
            if m[2]:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at is not None and (tag not in INLINE or all(s[0] in INLINE for s in stack[at:])):
                    links -= sum(s[0] == "a" for s in stack[at:])
                    del stack[at:]
            elif tag not in VOID and not (m[4].endswith("/") and tag not in ("p", "div")):
                while stack and tag not in INLINE and (stack[-1][0] in INLINE or tag in CLOSED_BY.get(stack[-1][0], ())):
                    links -= stack[-1][0] == "a"
                    stack.pop()
                links += tag == "a"
                stack.append((tag, _slots(tag, m[4])))
    flush()
    return out


@lru_cache(maxsize=100000)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_DIM


def features(blocks: list[Block]) -> np.ndarray:
    """One row of DIM numbers per block."""
    x = np.zeros((len(blocks), DIM), np.float32)
    for k, b in enumerate(blocks):
        x[k, list(b.path)] = 1
        x[k, PATH_DIM + zlib.crc32(b.leaf.encode()) % LEAF_DIM] = 1
        words = b.text.split(" ")
        at = np.fromiter((_word_slot(w) for w in words), np.int64, len(words))
        x[k, PATH_DIM + LEAF_DIM : PATH_DIM + LEAF_DIM + WORD_DIM] = np.bincount(at, minlength=WORD_DIM) / max(16, len(words))
        n = len(b.text)
        x[k, -SHAPE_DIM:] = [math.log1p(n) / 8, b.linked / n, sum(map(b.text.count, ".,;:!?")) / (len(words) + 1), b.depth / 10, k / len(blocks), math.log1p(len(words)) / 6, b.text[-1] in ".!?", 1]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        w = {"out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            w[f"W{d}"] = rng.normal(0, 0.05, (DIM, 4 * HIDDEN))
            w[f"U{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        b, t, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((b, t, HIDDEN), np.float32)
        inputs = x @ self.weights[f"W{d}"] + self.weights[f"c{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[:, s] + h @ self.weights[f"U{d}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, s : s + 1]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((s, h, c, i, f, o, u, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, s] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], 2)
        return both @ self.weights["out"] + self.weights["bias"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keeps: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, keeps[d]) for d in "fb"], 2)
        p = _sigmoid(both @ self.weights["out"] + self.weights["bias"])
        err = (p - y) * mask / max(1.0, mask.sum())
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / max(1.0, mask.sum()))
        grad = {"out": np.einsum("bt,bth->h", err, both), "bias": err.sum().reshape(1)}
        dh_out = err[..., None] * self.weights["out"]
        for n, d in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            du = np.zeros_like(self.weights[f"U{d}"])
            for s, h0, c0, i, f, o, u, tc, m in reversed(keeps[d]):
                dh = dh + dh_out[:, s, n * HIDDEN : (n + 1) * HIDDEN]
                dnew = dh * m
                dc2 = dc * m + dnew * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * u * i * (1 - i), dc2 * c0 * f * (1 - f), dnew * tc * o * (1 - o), dc2 * i * (1 - u * u)], 1)
                dz_all[:, s] = dz
                du += h0.T @ dz
                dh, dc = dh * (1 - m) + dz @ self.weights[f"U{d}"].T, dc * (1 - m) + dc2 * f
            grad[f"U{d}"], grad[f"c{d}"] = du, dz_all.sum((0, 1))
            grad[f"W{d}"] = x.reshape(-1, DIM).T @ dz_all.reshape(-1, 4 * HIDDEN)
        return loss, grad


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, sequences))
    x, mask = np.zeros((len(sequences), t, DIM), np.float32), np.zeros((len(sequences), t), np.float32)
    for k, s in enumerate(sequences):
        x[k, : len(s)], mask[k, : len(s)] = s, 1
    return x, mask


def label_pages(labeller: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For every block of every page whether it is main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):  # pages of similar length together, about 20,000 blocks at once
        take = max(1, min(256, 20000 // len(pages[order[at]])))
        part = order[at : at + take]
        while len(part) > 1 and len(part) * len(pages[part[-1]]) > 40000:
            part = part[: len(part) // 2]
        x, mask = padded([features(pages[k]) for k in part])
        good = labeller.scores(x, mask) > 0
        for row, k in enumerate(part):
            out[k] = good[row, : len(pages[k])]
        at += len(part)
    return out


# training pages: fixed values, the names of parts of pages
MAIN = ["article", "article", "main", "main article", "div.content", "div#content", "div.post-body", "section.story", "div.article-body", "div.entry-content", "div#main-text div.text", "main div.page-content", "body", "div.wrapper article.post", "div#container main#main"]
OTHER = ["nav ul@li a", "div.menu@a", "header div.logo", "header nav ul@li a", "header p.tagline", "footer p", "footer", "div.footer p", "footer ul@li a", "aside p", "aside h3", "aside ul@li a", "div.sidebar p", "div#sidebar ul@li a", "div.ad", "div.ad p", "div.advert p", "div.ads", "div.promo p", "div.sponsored p", "section.advertisement p", "div.cookie-notice p", "div.notice p", "div.cookie p", "div.banner", "div.alert p", "div.consent p", "form@label", "form p", "form.newsletter p", "div.subscribe p", "form.search button", "div.login form@label", "div.comments div.comment p", "section#comments p", "section.comments article.comment p", "ol.comment-list li p", "div.comment", "div#disqus p", "ul.breadcrumb@li a", "div.related h3", "div.related ul@li a", "div.share@a", "div.social@a", "div.pagination@a", "div.popup p", "div.modal p", "select@option", "div.widget p", "div.copyright", "div.header p", "div.top-bar@a", "div.author-bio p", "div.tags@a", "div.disclaimer p"]
INNER = ["div.ad", "aside p", "div.share@a", "form p", "div.related ul@li a", "div.comments p", "figure div.promo p", "div.newsletter p", "nav ul@li a", "div.notice p", "section.comments div.comment p", "footer p"]


def _open(spec: str) -> tuple[str, str]:
    opened, closed = "", ""
    for part in spec.split():
        m = re.fullmatch(r"(\w+)(?:([.#])([\w-]+))?", part)
        names = f' {"class" if m[2] == "." else "id"}="{m[3]}"' if m[2] else ""
        if m[1] != "body":
            opened, closed = f"{opened}<{m[1]}{names}>", f"</{m[1]}>{closed}"
    return opened, closed


def training_page(rng: np.random.Generator, words: list[str]) -> tuple[str, set[str]]:
    """A page with known parts; the set of its main-text blocks. Every block starts with a
    serial number, by which it is found again."""
    serial, main = 0, set()

    def text(low: int, high: int, good: bool) -> str:
        nonlocal serial
        serial += 1
        n = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        got = [words[k] for k in rng.integers(0, len(words), n)]
        if good:
            main.add(f"#{serial}")
        return f"#{serial} " + " ".join(got) + ("." if n > 6 and rng.random() < 0.7 else "")

    def other(spec: str) -> str:
        outer, _, item = spec.partition("@")
        a, b = _open(outer)
        if item:
            c, d = _open(item)
            return a + "".join(c + text(1, 4, False) + d for _ in range(rng.integers(1, 8))) + b
        return "".join(a + text(2, 90 if rng.random() < 0.5 else 15, False) + b for _ in range(rng.integers(1, 4)))

    def body() -> str:
        out = ""
        kinds = rng.choice(["p", "p", "p", "p", "open", "h2", "ul", "quote", "pre", "table", "bare", "bold"], rng.integers(1, 14))
        for kind in kinds:
            if kind == "h2":
                out += f"<h{rng.integers(2, 5)}>{text(2, 10, True)}</h2>"
            elif kind in ("ul", "table"):
                rows = [text(2, 25, True) for _ in range(rng.integers(1, 5))]
                out += "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>" if kind == "ul" else "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>"
            elif kind == "quote":
                out += f"<blockquote><p>{text(5, 60, True)}</p></blockquote>"
            elif kind == "pre":
                out += f"<pre>{text(5, 40, True)}</pre>"
            elif kind == "bare":
                out += f"<div>{text(5, 90, True)}</div>"
            elif kind == "open":
                out += f"<p>{text(5, 120, True)}<br>"
            elif kind == "bold":
                out += f"<p><b>{text(2, 60, True)}<br><p>{text(3, 60, True)}</p>"
            else:
                out += f"<p>{text(2, 160, True)}</p>"
            if rng.random() < 0.06:
                out += other(str(rng.choice(INNER)))
        return out

    before = "".join(other(str(s)) for s in rng.choice(OTHER, rng.integers(0, 5)))
    after = "".join(other(str(s)) for s in rng.choice(OTHER, rng.integers(0, 6)))
    a, b = _open(str(rng.choice(MAIN)))
    title = f"<h1>{text(2, 14, True)}</h1>" if rng.random() < 0.7 else ""
    return f"<html><body>{before}{a}{title}{body()}{b}{after}</body></html>", main


def train(words: list[str], seed: int = SEED, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted by Adam to training pages over the given words."""
    rng = np.random.default_rng(seed)
    words = words or ["word"]
    data = []
    for _ in range(pages):
        page, main = training_page(rng, words)
        got = blocks_of(page)
        y = np.array([b.text.partition(" ")[0] in main for b in got], np.float32)
        for b in got:
            b.text = b.text.partition(" ")[2] or b.text
        data.append((features(got), y))
    data = [d for d in data if len(d[1])]
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = np.argsort([len(d[1]) + rng.uniform(0, 8) for d in data])
        batches = [order[k : k + 16] for k in range(0, len(order), 16)]
        for k in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[k]])
            y = np.zeros_like(mask)
            for row, i in enumerate(batches[k]):
                y[row, : len(data[i][1])] = data[i][1]
            _, grad = model.gradient(x, mask, y)
            step += 1
            rate = 0.01 * (0.5 ** max(0, epoch - epochs // 2))
            size = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.weights[name] = (model.weights[name] * (1 - 1e-4 * (name[0] == "W")) - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sample_words(pages: DataFrame, bound: int = SAMPLE_PAGES) -> list[str]:
    """All words of at most ``bound`` pages, chosen by a hash of the id."""
    # ids first: a top-k of whole pages would send k of them from every task
    ids = [r[0] for r in pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(bound).collect()]
    rows = pages.where(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"]).orderBy("page_id").collect()
    return sorted({w for r in rows for b in blocks_of(r["html"] or "") for w in b.text.split(" ")})


def extract_main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text) for every row of pages: its main-text blocks joined by spaces.

    Null and empty pages, and pages without main text, give an empty text. All
    words of a block are hashed, however long it is.
    Repeated rows are labelled alike; other columns are ignored; an empty table
    gives no rows. Pages are read whole; no shuffle takes place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [blocks_of(p or "") for p in part.column("html").to_pylist()]
                good = label_pages(labeller, found)
                texts = [" ".join(b.text for b, g in zip(bs, gs, strict=True) if g) for bs, gs in zip(found, good, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = extract_main_text(pages, train(sample_words(pages)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
