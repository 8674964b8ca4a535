"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks (``html_blocks``). A block is described by its
word count and link density, those of the block before and after it, and by
what the elements around it say (a heading, a list item, an element or class
that names main text, navigation, comments, ...). A small decision tree, fitted
on a labelled table of pages (``main_text_samples``), keeps or drops each block;
kept blocks are joined in page order by an empty line.

Pages are independent of each other, so a table is one scan without a shuffle;
the tree travels with the task. The labelled table is a parameter; the driver
holds its blocks while the tree is fitted, and nothing else.

A null or empty page has an empty text. Whole pages are read, nothing is cut or
capped, and broken markup costs linear time. Null ids and repeated rows stay as
they are. An empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .html_blocks import FEATURES, blocks, features
from .main_text_samples import labelled_pages

#: A tree: nested (feature, limit, below or equal, above), or 0 / 1 at a leaf.
Tree = tuple | int


def labelled_blocks(pages: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages: 1 inside an element
    with ``data-main``, 0 inside one with ``data-rest`` and elsewhere."""
    found = [b for b in map(blocks, pages) if b]
    x = np.vstack([features(b) for b in found]) if found else np.zeros((0, len(FEATURES)))
    return x, np.array([b.state.label for page in found for b in page], dtype=np.int64)


def fit(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 5) -> Tree:
    """Splits of least Gini impurity, first feature and lowest limit on ties;
    ``least`` rows at least on either side of a split."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return int(2 * ones > len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        n = np.arange(1, len(y))
        at = np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least))
        if len(at):
            k, p = n[at], left[at]
            impurity = p * (k - p) / k + (ones - p) * (len(y) - k - ones + p) / (len(y) - k)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0] - 1e-9:
                best = (float(impurity[i]), f, float(v[at[i]] + v[at[i] + 1]) / 2)
    if best is None:
        return int(2 * ones > len(y))
    _, f, limit = best
    low = x[:, f] <= limit
    return f, limit, fit(x[low], y[low], depth - 1, least), fit(x[~low], y[~low], depth - 1, least)


def kept(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is main text."""
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    f, limit, below, above = tree
    low, out = x[:, f] <= limit, np.empty(len(x), dtype=bool)
    out[low], out[~low] = kept(below, x[low]), kept(above, x[~low])
    return out


def train(pages: Iterable[str] | None = None) -> Tree:
    """The tree for a labelled table of pages (by default the one given here)."""
    x, y = labelled_blocks(labelled_pages() if pages is None else pages)
    return fit(x, y) if len(y) else 0


def main_blocks(page: str | None, tree: Tree) -> list[str]:
    found = blocks(page)
    return [b.text for b, k in zip(found, kept(tree, features(found))) if k] if found else []


def main_text(pages: DataFrame, tree: Tree, html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_kept): the main text of every page, its
    code points and its blocks."""
    def run(batches):
        for b in batches:
            found = [main_blocks(page, tree) for page in b.html]
            text = ["\n\n".join(x) for x in found]
            yield b.drop(columns="html").assign(page_id=b.page_id.astype("Int64"), text=text, n_chars=list(map(len, text)),
                                                n_kept=list(map(len, found)))

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_kept long")
