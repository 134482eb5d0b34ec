"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags. Each has a vector of its tag path (hashed tag, class and id
names), of its words (hashed) and a few lengths. A bidirectional LSTM in numpy reads the sequence of a page's blocks, so
each is labelled in the context of the whole page, and blocks labelled as main text are joined.

The labeller is fitted here, on pages made up by `made_page` (many layouts; the words of main text and of the rest come from the
same vocabulary) and on a bounded sample: at most SAMPLE real pages of at most SAMPLE_BYTES bytes whose markup names its parts. Extraction reads every page whole.

Edge cases: a null or empty page has the text ''; text without tags is one block; unclosed and stray tags, and a page that
ends inside a tag, are read as browsers do in the main; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import bounded_batches, table

PATHS, WORDS, NUMBERS, HIDDEN = 96, 32, 6, 24
#: Real pages that are fitted on, at most, and the bytes of each, at most.
SAMPLE, SAMPLE_BYTES = 200, 100_000
MADE, EPOCHS, RATE, TOGETHER = 700, 10, 0.01, 24

# Elements that run inside a block, that have no content, whose content is no text, and that end an open element of the same kind; fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_SELF = set("p li dt dd tr td th option".split())
BLOCK_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(script|style|noscript|template|svg|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)"
    r"|<[!?][^>]*(?:>|$)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path, share of its characters inside links) of each leaf block that has text."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, str]] = []  # tag and what it adds to the path
    pieces: list[str] = []
    linked = links = 0
    at = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, tuple(x[1] for x in stack if x[0] not in INLINE), linked / len(raw)))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ending = bool(m[2] or m[5])
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if ending else 1))
            continue
        close()
        links = 0
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in ENDS_SELF or tag in BLOCK_ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag == tag and tag in ENDS_SELF or open_tag == "p" and tag in BLOCK_ENDS_P:
                    del stack[k:]
                    break
                if open_tag in ("ul", "ol", "table", "div", "section", "article", "body", "dl"):
                    break
        attributes = m[4] or m[7] or ""
        stack.append((tag, tag + " " + " ".join("".join(x) for x in NAMES.findall(attributes)).lower() if "=" in attributes else tag))
    if at < len(page):
        pieces.append(page[at:])
        if links:
            linked += len(page) - at
    close()
    return out


_path_parts: dict[tuple[str, ...], np.ndarray] = {}


def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Hashed slots of the names on a path; the innermost element counts again on its own."""
    if path not in _path_parts:
        if len(_path_parts) > 20_000:
            _path_parts.clear()
        found = []
        for k, element in enumerate(path):
            tag, _, names = element.partition(" ")
            for x in [tag, *("." + n for n in PART.findall(names))] + (["!" + tag] if k == len(path) - 1 else []):
                h = 2166136261
                for c in x.encode():
                    h = (h ^ c) * 16777619 & 0xFFFFFFFF
                found += [(h >> 7) % PATHS, (h >> 17) % PATHS]
        _path_parts[path] = np.array(found, np.int64)
    return _path_parts[path]


_VALUES = K.byte_values(7)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def vectors(pages: list[list[tuple[str, tuple[str, ...], float]]]) -> np.ndarray:
    """One row for each block of all pages, in order."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    x = np.zeros((n, PATHS + WORDS + NUMBERS), np.float32)
    if not n:
        return x
    slots = [_path_slots(b[1]) for b in flat]
    row = np.repeat(np.arange(n), [len(s) for s in slots])
    x[:, :PATHS] = np.minimum(np.bincount(row * PATHS + np.concatenate(slots), minlength=n * PATHS).reshape(n, PATHS), 2)
    data, offsets = K.column_bytes(pa.array([b[0] for b in flat], pa.large_string()))
    for i, j in K.slices(offsets):
        part, bounds = K.lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        s, e = K.words(part, bounds, _IS_WORD)
        of = np.searchsorted(bounds, s, "right") - 1
        slot = (K.span_hashes(part, s, e, _VALUES) % K.U64(WORDS)).astype(np.int64)
        count = np.bincount(of * WORDS + slot, minlength=(j - i) * WORDS).reshape(j - i, WORDS)
        x[i:j, PATHS : PATHS + WORDS] = count / np.maximum(count.sum(1, keepdims=True), 1)
        x[i:j, -6] = np.log1p(count.sum(1)) / 4
    length = np.diff(offsets)
    x[:, -5] = np.log1p(length) / 6
    x[:, -4] = [b[2] for b in flat]
    place = np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in pages if p])
    x[:, -3], x[:, -2] = place, 1 - place
    x[:, -1] = [b[0][-1] in ".!?" for b in flat]
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output; the parameters are a dict of arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        r = np.random.Generator(np.random.PCG64(seed))
        d, h = PATHS + WORDS + NUMBERS, HIDDEN
        p = {}
        for w in "fb":
            p[w + "x"] = r.normal(0, 0.1, (d, 4 * h)).astype(np.float32)
            p[w + "h"] = r.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            p[w + "1"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        p["o"] = r.normal(0, 0.2, (2 * h + d,)).astype(np.float32)
        p["o1"] = np.zeros(1, np.float32)
        return cls(p)

    def _run(self, w: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, (steps, pages, HIDDEN), and what the way back needs. mask: 1 where a block is."""
        p, h = self.p, HIDDEN
        steps, n, _ = x.shape
        pre = x @ p[w + "x"] + p[w + "1"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((steps, n, h), np.float32), []
        for t in range(steps) if w == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ p[w + "h"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            m = mask[t][:, None]
            before, was = state, cell
            cell = m * (f * cell + i * new) + (1 - m) * cell
            th = np.tanh(cell)
            state = m * (o * th) + (1 - m) * state
            out[t] = state
            kept.append((t, before, was, i, f, o, new, th, m))
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self._run("f", x, mask)
        b, kb = self._run("b", x, mask)
        both = np.concatenate([f, b, x], 2)
        return both @ self.p["o"] + self.p["o1"], (kf, kb, both)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (kf, kb, both) = self.logits(x, mask)
        dz = mask * (1 / (1 + np.exp(-z)) - y) / max(mask.sum(), 1)
        g = {"o": np.einsum("tn,tnk->k", dz, both), "o1": np.array([dz.sum()], np.float32)}
        h = HIDDEN
        for w, kept, cut in (("f", kf, 0), ("b", kb, h)):
            dout = dz[:, :, None] * self.p["o"][cut : cut + h]
            gx, gh, g1 = np.zeros_like(self.p[w + "x"]), np.zeros_like(self.p[w + "h"]), np.zeros_like(self.p[w + "1"])
            ds = np.zeros_like(kept[0][1])
            dc = np.zeros_like(ds)
            for t, before, was, i, f, o, new, th, m in reversed(kept):
                ds = ds + dout[t]
                live = m * ds
                dcell = m * (dc + live * o * (1 - th * th))
                d = np.concatenate([dcell * new * i * (1 - i), dcell * was * f * (1 - f), live * th * o * (1 - o), dcell * i * (1 - new * new)], 1)
                gx += x[t].T @ d
                gh += before.T @ d
                g1 += d.sum(0)
                dc = dcell * f + (1 - m) * dc
                ds = d @ self.p[w + "h"].T + (1 - m) * ds
            g |= {w + "x": gx, w + "h": gh, w + "1": g1}
        return g

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """The probability of being main text for each block of each page."""
        x = vectors(pages)
        first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(int)
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = np.argsort(np.diff(first), kind="stable")
        order = order[np.diff(first)[order] > 0]
        i = 0
        while i < len(order):
            longest = 1
            j = i
            while j < len(order) and (j - i) < 256 and (longest := len(pages[order[j]])) * (j - i + 1) <= 30_000 or j == i:
                j += 1
            some = order[i:j]
            steps = max(len(pages[k]) for k in some)
            block, mask = np.zeros((steps, len(some), x.shape[1]), np.float32), np.zeros((steps, len(some)), np.float32)
            for c, k in enumerate(some):
                n = len(pages[k])
                block[:n, c], mask[:n, c] = x[first[k] : first[k + 1]], 1
            z, _ = self.logits(block, mask)
            for c, k in enumerate(some):
                out[k] = 1 / (1 + np.exp(-np.clip(z[: len(pages[k]), c], -50, 50)))
            i = j
        return out


def made_page(r: np.random.Generator) -> tuple[str, dict[str, int]]:
    """A made-up page and the label of each block text."""
    syllables = "an re th er on ti st ed ou or in es la de que men cio ar os ver sch ich ein le eau pa té ñi".split()
    labels: dict[str, int] = {}

    def word() -> str:
        return "".join(syllables[k] for k in r.integers(0, len(syllables), r.integers(1, 5)))

    def sentence(n: int) -> str:
        return (" ".join(word() for _ in range(n))).capitalize() + str(r.choice([".", ".", ".", "", "?", "!"]))

    def text(label: int, least: int, most: int) -> str:
        n, x = int(r.integers(least, most + 1)), ""
        while not x or x in labels:
            parts, left = [], n
            while left > 0:
                k = min(left, int(r.integers(1, 14)))
                parts.append(sentence(k))
                left -= k
            x = " ".join(parts)
            n += 1
        labels[x] = label
        return x

    def pick(*x: str) -> str:
        return str(x[int(r.integers(len(x)))])

    def link_list(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{text(0, 1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def prose(n: int, label: int) -> str:
        out = []
        for _ in range(n):
            roll = r.random()
            if roll < 0.12:
                out.append(f"<p><b>{text(label, 1, 14)}<br>")
            elif roll < 0.2:
                out.append(f"<h{int(r.integers(2, 5))}>{text(label, 1, 8)}</h2>")
            elif roll < 0.26:
                out.append("<ul>" + "".join(f"<li>{text(label, 2, 16)}</li>" for _ in range(int(r.integers(2, 5)))) + "</ul>")
            elif roll < 0.3:
                out.append(f"<blockquote><p>{text(label, 4, 30)}</p></blockquote>")
            elif roll < 0.33:
                out.append(f"<pre>{text(label, 3, 20)}</pre>")
            elif roll < 0.36:
                out.append("<table><tr>" + "".join(f"<td>{text(label, 1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif roll < 0.4:
                out.append(f"<div>{text(label, 5, 40)}</div>")
            elif roll < 0.5:
                out.append(f"<p>{text(label, 1, 3)}</p>")
            else:
                out.append(f"<p>{text(label, 4, 70)}</p>")
        return "".join(out)

    def ad() -> str:
        return _named(r, "div", pick("class", "id"), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad banner"), text(0, 2, 14))

    def comments() -> str:
        each = "".join(_named(r, "div", "class", pick("comment", "reply", "comment-body"), f"<p>{text(0, 3, 40)}</p>") for _ in range(int(r.integers(1, 6))))
        return _named(r, pick("section", "div"), pick("class", "id"), pick("comments", "comment-list", "discussion", "responses"), f"<h3>{text(0, 1, 3)}</h3>{each}")

    body = []
    if r.random() < 0.4:
        body.append(_named(r, "header", "", "", f'<div class="logo">{text(0, 1, 3)}</div><p>{text(0, 2, 8)}</p>') if r.random() < 0.5 else _named(r, "div", pick("class", "id"), pick("header", "top", "masthead", "site-header"), f"<p>{text(0, 1, 8)}</p>"))
    if r.random() < 0.85:
        body.append(_named(r, "nav", "", "", link_list(int(r.integers(2, 9)))) if r.random() < 0.6 else _named(r, "div", pick("class", "id"), pick("nav", "menu", "navbar", "navigation", "breadcrumb"), link_list(int(r.integers(2, 9)))))
    if r.random() < 0.3:
        body.append(_named(r, "div", pick("class", "id", "role"), pick("cookie", "cookie-notice", "notice", "banner", "consent", "alert"), f"<p>{text(0, 4, 25)}</p>"))
    if r.random() < 0.5:
        body.append(ad())
    side = _named(r, "aside", "", "", prose(int(r.integers(1, 4)), 0)) if r.random() < 0.5 else _named(r, "div", pick("class", "id"), pick("sidebar", "side", "related", "widget", "newsletter"), f"<h3>{text(0, 1, 3)}</h3>" + pick(link_list(3), f"<p>{text(0, 3, 25)}</p>"))
    if r.random() < 0.25:
        body.append(side)
        side = ""
    main = f"<h1>{text(1, 1, 12)}</h1>" if r.random() < 0.9 else ""
    n = int(r.integers(1, 12))
    main += prose(n, 1)
    if r.random() < 0.25:
        main += ad() + prose(int(r.integers(1, 4)), 1)
    if r.random() < 0.15:
        main += _named(r, "div", "class", pick("share", "social", "tags"), link_list(3))
    if r.random() < 0.12:
        main += comments()
    tag, kind, name = ("article", "", "") if r.random() < 0.5 else ("main", "", "") if r.random() < 0.3 else (pick("div", "section", "div"), pick("class", "id"), pick("content", "main", "post", "article", "entry-content", "post-body", "story", "text"))
    body.append(_named(r, tag, kind, name, main) if r.random() < 0.93 else main)
    if side and r.random() < 0.45:
        body.append(side)
    if r.random() < 0.35:
        body.append(comments())
    if r.random() < 0.25:
        body.append(f'<form action="/x"><p>{text(0, 1, 8)}</p><label>{text(0, 1, 3)}</label><input name="q"><div>{text(0, 1, 2)}</div></form>')
    if r.random() < 0.85:
        foot = pick("&copy; ", "", "© ") + f"{word()}.example.com &middot; "
        end = text(0, 2, 16)
        labels[" ".join(html.unescape(foot + end).split())] = 0
        body.append(_named(r, "footer", "", "", foot + end) if r.random() < 0.65 else _named(r, "div", pick("class", "id"), pick("footer", "bottom", "copyright", "legal"), foot + end))
    cut = "" if r.random() < 0.1 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(body)}{cut}", labels


def _named(r: np.random.Generator, tag: str, kind: str, name: str, inside: str) -> str:
    attribute = f' {kind}="{name}"' if kind else ""
    return f"<{tag}{attribute}>{inside}</{tag}>"


# Elements and names that mark the parts of a page in its own markup; fixed values.
MAIN = {"article", "main"}
REST = set(
    "nav navbar navigation breadcrumb menu aside sidebar footer header masthead form ad ads advert advertisement sponsored promo comments comment reply responses discussion cookie consent notice "
    "alert banner share social tags related widget newsletter copyright legal".split()
)


def marked(found: list[tuple[str, tuple[str, ...], float]]) -> list[int] | None:
    """Labels by the names in a page's own markup; None if it names no main part."""
    names = [[set(PART.findall(e)) for e in b[1]] for b in found]
    if not any(e & MAIN for path in names for e in path):
        return None
    out = []
    for path in names:
        label = 0
        for e in path:
            label = 1 if e & MAIN else 0 if e & REST else label
        out.append(label)
    return out


def fit(real: list[str], *, made: int = MADE, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    r = np.random.Generator(np.random.PCG64(seed))
    pages, labels = [], []
    for _ in range(made):
        page, known = made_page(r)
        found = blocks(page)
        pages.append(found)
        labels.append(np.array([known.get(b[0], 0) for b in found], np.float32))
    for page in real:
        found = blocks(page)
        if found and (y := marked(found)):
            pages.append(found)
            labels.append(np.array(y, np.float32))
    x = vectors(pages)
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(int)
    model = Labeller.fresh(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(q) for k, q in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(r.permutation(len(pages)), key=lambda k: len(pages[k]) // 12)
        groups = [order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)]
        for g in r.permutation(len(groups)):
            some = groups[g]
            steps = max(len(pages[k]) for k in some)
            if not steps:
                continue
            block, mask, y = np.zeros((steps, len(some), x.shape[1]), np.float32), np.zeros((steps, len(some)), np.float32), np.zeros((steps, len(some)), np.float32)
            for c, k in enumerate(some):
                n = len(pages[k])
                block[:n, c], mask[:n, c], y[:n, c] = x[first[k] : first[k + 1]], 1, labels[k]
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for k, g_ in model.gradients(block, mask, y).items():
                g_ = np.clip(g_, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g_
                v[k] = 0.99 * v[k] + 0.01 * g_ * g_
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def _extracted(batches: Iterator[pa.RecordBatch], model: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str] = []
        pages = batch.column(batch.num_columns - 1).to_pylist()
        i = 0
        while i < len(pages):
            found, size = [], 0
            while i < len(pages) and (not found or size < (4 << 20)):
                page = pages[i] or ""
                size += len(page)
                found.append(blocks(page))
                i += 1
            for b, p in zip(found, model.label(found), strict=True):
                texts.append("\n".join(x[0] for x, q in zip(b, p, strict=True) if q >= 0.5))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])


_models: dict[tuple, Labeller] = {}


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every page. The labeller is fitted on at most `sample` of the pages of at most `sample_bytes` bytes."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    short = rows.where(F.octet_length("html") <= sample_bytes).where("page_id is not null")
    short = short.withColumn("h", F.xxhash64("page_id")).withColumn("g", F.xxhash64("html"))
    few = short.select("page_id", "h", "g").distinct().orderBy("h", "page_id", "g").limit(sample)
    pairs = short.join(F.broadcast(few), ["page_id", "h", "g"]).select("page_id", "html")
    real = [r[1] for r in sorted(pairs.distinct().limit(sample).collect())]
    key = (len(real), hash(tuple(real)))
    if key not in _models:
        _models.clear()
        _models[key] = fit(real)
    shared = spark.sparkContext.broadcast(_models[key])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda x: _extracted(x, shared.value), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
