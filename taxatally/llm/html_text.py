"""The main text of pages: what a site repeats on its pages is found by suffix arrays and removed.

A page is parsed into blocks. The words of all blocks outside articles, with a mark before each
block and for each article, are its stream; the streams of a host are put one after another and
their suffixes sorted. A run of ``RUN`` tokens or more that stands on several distinct pages, or a
shorter block that does as a whole, is boilerplate of the host; what remains of the blocks is kept,
and so are stretches of a block shorter than a run that one covers together with other blocks.
A run must stand on three pages (two, if the host has no more) and on ``RATIO`` of the host's pages.

Pages are distinct if their articles are; pages without one are copies of each other if a run
makes up four fifths of both, and count as one. So an article or a page that was copied isn't taken for
boilerplate. What the markup says counts too: text inside ``article`` or ``main`` stays, and blocks
marked as menu, header, footer, sidebar, notice, advert, form or comment go even where a page has
its own (``n_marked`` counts their words that no run covers).

A host with many pages is cut into parts of about ``PART`` bytes of html by a hash of the article, or of a
page without one; each part is sorted by itself and what it finds, on one page or more, is added up over
the host. Only copies among pages without an article are told within parts.

A null or empty page has an empty text. Pages without a url, or whose url names no host, are one host.
Repeated rows stay and equal pages count once. An empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .chunks import ragged
from .html_blocks import ARTICLE, MARKED, blocks
from .line_dedup import host_of
from .words import bound_batches, bounds, grams, text_bytes, word_hashes

#: Tokens of a run, share of a host's pages, pages at least.
RUN, RATIO, LEAST = 8, 0.01, 3
#: Bytes of html in a part of a host, and tokens whose suffixes are sorted at once.
PART, SORTED = 2 << 20, 1 << 21

_PAD, _ARTICLE_MARK = np.uint64(1), np.uint64(2)
_SEED = np.uint64(0x2545F4914F6CDD1D)


def _hashes(texts: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:], False)


class Streams:
    """The tokens of pages outside their articles, one page after another.

    ``owner`` says of each token which block of all pages its word is of, -1 for marks and pads;
    ``edges`` where pages begin; ``sizes`` how many words each block has (0 in articles). A block of
    fewer than ``run`` tokens is filled up with pads, so that it makes one run as a whole.
    """

    def __init__(self, pages: list[list[tuple[int, str, str]]], run: int = RUN):
        every = [b for page in pages for b in page]
        open_ = [i for i, (kind, _, _) in enumerate(every) if kind != ARTICLE]
        data, offsets = text_bytes(pa.array([every[i][2] for i in open_], pa.string()))
        starts, ends = bounds(data, offsets)
        n_words = np.diff(np.searchsorted(starts, offsets))
        self.sizes = np.zeros(len(every), np.int64)
        self.sizes[open_] = n_words
        # A unit is a block outside an article, or all blocks of an article between such.
        kinds = np.array([kind for kind, _, _ in every], np.int8)
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        inside = kinds == ARTICLE
        goes_on = np.zeros(len(every), bool)
        goes_on[1:] = inside[1:] & inside[:-1] & (page[1:] == page[:-1])
        unit = np.flatnonzero(~goes_on)
        names = {tag: i for i, tag in enumerate(dict.fromkeys(tag for _, tag, _ in every))}
        marks = (_hashes(list(names)) ^ _SEED)[[names[every[i][1]] for i in unit]] if len(unit) else np.empty(0, np.uint64)
        marks = np.where(inside[unit], _ARTICLE_MARK, marks)
        words = self.sizes[unit]
        pads = np.where(inside[unit], 0, np.maximum(0, run - 1 - words))
        begin = np.cumsum(1 + words + pads) - (1 + words + pads)
        self.tokens = np.full(int((1 + words + pads).sum()), _PAD)
        self.tokens[begin] = marks
        place = ragged(begin + 1, words)
        self.tokens[place] = word_hashes(data, starts, ends, False)
        self.owner = np.full(len(self.tokens), -1)
        self.owner[place] = np.repeat(unit, words)
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(page[unit], weights=1 + words + pads, minlength=len(pages)).astype(np.int64))))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a page, and which of them are marks or pads."""
        part = slice(self.edges[i], self.edges[i + 1])
        return self.tokens[part], self.owner[part] < 0

    def windows(self, run: int = RUN) -> np.ndarray:
        """Hash of the run that begins at each token; 0 where none can (see ``run_hashes``)."""
        out = run_hashes(self.tokens, self.owner < 0, run)
        page = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        out[page[: len(out)] != page[len(page) - len(out) :]] = 0
        return out


def articles(pages: list[list[tuple[int, str, str]]]) -> np.ndarray:
    """Hash of the article of each page, 0 where there is none."""
    texts = ["\n".join([t for k, _, t in page if k == ARTICLE]) for page in pages]
    return np.where([bool(t) for t in texts], _hashes(texts), np.uint64(0)) if pages else np.empty(0, np.uint64)


def run_hashes(tokens: np.ndarray, is_mark: np.ndarray, run: int) -> np.ndarray:
    """Hash of the ``run`` tokens from each place on; with pads in them only from a mark on."""
    if len(tokens) < run:
        return np.empty(0, np.uint64)
    out = grams(tokens, run)
    out[out == 0] = 1
    pads = np.concatenate(([0], np.cumsum(tokens == _PAD)))
    padded = pads[run:] - pads[:-run] > 0
    begins = is_mark[: len(out)] & (tokens[: len(out)] != _PAD)
    out[padded & ~begins] = 0
    return out


def suffixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how many tokens each has in common with the one before it.

    By doubling: the order by the first 2^k tokens gives that by the first 2^(k+1). Places beyond the end
    sort first. The orders of all steps are kept, and common lengths read off them from the longest down.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    steps, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n and width < n and rank.max() < n:
        behind = np.zeros(n, np.int64)
        behind[:-width] = rank[width:]
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1])))
        steps.append(rank)
        width *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b, same = order[:-1], order[1:], np.zeros(n - 1, np.int64)
        for k in range(len(steps) - 1, -1, -1):
            x, y = a + same, b + same
            inside = (x < n) & (y < n)
            equal = inside & (steps[k][np.minimum(x, n - 1)] == steps[k][np.minimum(y, n - 1)])
            same += np.where(equal, 1 << k, 0)
        common[1:] = same
    return order, common


def _families(page: np.ndarray, order: np.ndarray, common: np.ndarray, lengths: np.ndarray, article: np.ndarray) -> np.ndarray:
    """A number for each page; pages that copy each other have the same."""
    parent = np.unique(article, return_inverse=True)[1]
    own = np.arange(len(article))
    _, first = np.unique(article, return_index=True)
    family = np.where(article == 0, own, first[parent])
    a, b = page[order[:-1]], page[order[1:]]
    copies = (a != b) & (5 * common[1:] >= 4 * np.maximum(lengths[a], lengths[b])) & (article[a] == 0) & (article[b] == 0) & (common[1:] > 0)
    root = family.tolist()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in set(zip(a[copies].tolist(), b[copies].tolist(), strict=True)):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return np.array([top(i) for i in range(len(root))], dtype=np.int64)


def repeated_runs(streams: list[tuple[np.ndarray, np.ndarray, np.uint64]], run: int = RUN, least: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the runs on ``least`` distinct pages or more, on how many they are, and the distinct pages.

    A stream is tokens, which of them are marks, and the hash of the page's article. All places
    whose next ``run`` tokens are the same stand together in the order of suffixes.
    """
    n_pages = len(streams)
    sizes = np.array([len(t) for t, _, _ in streams], np.int64)
    tokens = np.concatenate([np.append(t, np.uint64(0)) for t, _, _ in streams])
    marks = np.concatenate([np.append(m, True) for _, m, _ in streams])
    page = np.repeat(np.arange(n_pages), sizes + 1)
    # An end of its own for every page: no run goes from one page to the next.
    ends = np.cumsum(sizes + 1) - 1
    names, values = np.unique(tokens, return_inverse=True)
    values = values.astype(np.uint64)
    values[ends] = len(names) + np.arange(n_pages, dtype=np.uint64)
    order, common = suffixes(values)
    family = _families(page, order, common, sizes, np.array([a for _, _, a in streams], np.uint64))
    hashes = np.zeros(len(tokens), np.uint64)
    found = run_hashes(tokens, marks, run)
    hashes[: len(found)] = found
    hashes = hashes[order]
    group = np.cumsum(common < run)
    whole = (ends[page[order]] - order >= run) & (hashes != 0)
    pairs = np.unique(np.stack((group[whole], family[page[order]][whole]), axis=1), axis=0)
    groups, pages = np.unique(pairs[:, 0], return_counts=True)
    hash_of = np.zeros(int(group[-1]) + 1 if len(group) else 1, np.uint64)
    hash_of[group[whole]] = hashes[whole]
    often = pages >= least
    return hash_of[groups[often]], pages[often], len(np.unique(family))


def _parts(pages: DataFrame, part_bytes: int) -> DataFrame:
    """``page_id, url, html, host, part, parts``."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("size"))
    large = stored(sizes.filter(F.col("size") > part_bytes).select("host", F.ceil(F.col("size") / part_bytes).alias("parts")), "large_hosts")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    return rows.join(large, "host", "left").select("page_id", "url", "html", "host", F.pmod(F.xxhash64("html"), parts).alias("part"), parts.alias("parts"))


def boilerplate(rows: DataFrame, run: int = RUN, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host, parts, runs``: hashes of the boilerplate runs of each host that has any.

    A run stands on ``ratio`` of a host's distinct pages at least, so a host has as many runs as
    the mean page has tokens, divided by ``ratio``, and their list fits one row.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                some = batch.slice(first, 512)
                pages = [blocks(h) for h in some.column(3).to_pylist()]
                streams = Streams(pages, run)
                each = [streams[i] for i in range(len(pages))]
                lists = [pa.array([t.tobytes() for t, _ in each], pa.binary()), pa.array([np.packbits(m).tobytes() for _, m in each], pa.binary())]
                article = pa.array(articles(pages).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), some.column(4), article, *lists], names)

    names = ["host", "part", "parts", "page", "article", "tokens", "marks"]
    schema = "host string, part long, parts long, page long, article long, tokens binary, marks binary"
    streams = bound_batches(rows.filter("html is not null")).select("host", "part", "parts", "html", F.xxhash64("html").alias("page")).mapInArrow(parse, schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.uint64]] = []
        now, last, size, parts, whole = None, None, 0, 1, True

        def found() -> pa.RecordBatch:
            # What stands on one page here may stand on others elsewhere.
            hashes, pages, n = repeated_runs(held, run, 2 if whole and parts == 1 else 1)
            out = [pa.array([now[0]] * (len(hashes) + 1), pa.string()), pa.array([parts] * (len(hashes) + 1), pa.int64()), pa.array([None, *hashes.view(np.int64).tolist()], pa.int64()), pa.array([n, *pages.tolist()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["host", "parts", "run", "pages"])

        for batch in batches:
            columns = batch.to_pydict()
            for host, part, n_parts, page, article, tokens, marks in zip(*(columns[c] for c in names), strict=True):
                if held and ((host, part) != now or size > SORTED):
                    same = (host, part) == now
                    whole = whole and not same
                    yield found()
                    size, whole = 0, not same
                if (host, part, page) != last:  # equal pages count once
                    tokens = np.frombuffer(tokens, np.uint64)
                    held.append((tokens, np.unpackbits(np.frombuffer(marks, np.uint8), count=len(tokens)).astype(bool), np.int64(article).view(np.uint64)))
                    size += len(tokens)
                now, last, parts = (host, part), (host, part, page), n_parts
        if held:
            yield found()

    # Pages with the same article are one, so they go to one part.
    streams = streams.withColumn("part", F.pmod(F.when(F.col("article") != 0, F.xxhash64("article")).otherwise(F.col("page")), F.col("parts")))
    dealt = streams.repartition("host", "part").sortWithinPartitions("host", "part", "page")
    each = dealt.mapInArrow(sort, "host string, parts long, run long, pages long")
    counts = stored(each.groupBy("host", "parts", "run").agg(F.sum("pages").alias("pages")), "run_counts")
    totals = counts.filter("run is null").select("host", F.greatest(F.lit(2), F.least(F.lit(least), F.col("pages")), F.col("pages") * ratio).alias("needed"))
    often = counts.filter("run is not null").join(totals, "host").filter("pages >= needed")
    return often.groupBy("host", "parts").agg(F.collect_list("run").alias("runs"))


def _long_parts(gone: np.ndarray, least: int) -> np.ndarray:
    """Covered words of a block: all of them, or stretches of ``least`` and more.

    A run that goes on from the block before into the first words of this one leaves these alone.
    """
    if gone.all():
        return gone
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out = np.zeros(len(gone), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[a:b] = b - a >= least
    return out


def main_texts(pages: list[list[tuple[int, str, str]]], runs: np.ndarray, run: int = RUN) -> list[tuple[str, int, int]]:
    """Of each page its text without the ``runs`` (sorted), words they cover, other words of marked blocks."""
    streams = Streams(pages, run)
    covered = np.zeros(len(streams.sizes), np.int64)
    parts: dict[int, np.ndarray] = {}
    windows = streams.windows(run) if len(runs) else np.empty(0, np.uint64)
    if len(windows):
        place = np.minimum(np.searchsorted(runs, windows), len(runs) - 1)
        hit = np.flatnonzero((runs[place] == windows) & (windows != 0))
        change = np.zeros(len(streams.tokens) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + run, -1)
        gone = np.cumsum(change[:-1]) > 0
        word = np.flatnonzero(streams.owner >= 0)
        owner, gone = streams.owner[word], gone[word]
        covered = np.bincount(owner[gone], minlength=len(covered))
        first = np.searchsorted(owner, np.arange(len(covered)))
        for i in np.flatnonzero((covered > 0) & (covered < streams.sizes)).tolist():
            parts[i] = _long_parts(gone[first[i] : first[i] + streams.sizes[i]], run - 1)
            covered[i] = parts[i].sum()
    counts, sizes = covered.tolist(), streams.sizes.tolist()
    results, i = [], 0
    for page in pages:
        out, repeated, marked = [], 0, 0
        for kind, _, text in page:
            if kind == ARTICLE:
                out.append(text)
            else:
                repeated += counts[i]
                if kind == MARKED:
                    marked += sizes[i] - counts[i]
                elif not counts[i]:
                    out.append(text)
                elif counts[i] < sizes[i]:
                    out.append(" ".join([w for w, g in zip(text.split(" "), parts[i].tolist(), strict=True) if not g]))
            i += 1
        results.append(("\n".join(out), repeated, marked))
    return results


def extract(pages: DataFrame, run: int = RUN, ratio: float = RATIO, least: int = LEAST, part_bytes: int = PART) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated, n_marked`` of every row of ``page_id, url, html``.

    ``n_repeated`` counts the words outside articles that runs of the host cover.
    """
    kind, address = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    rows = _parts(pages, part_bytes)
    found = stored(boilerplate(rows, run, ratio, least), "boilerplate_runs")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                some = batch.slice(first, 512)
                every = [blocks(h) for h in some.column(4).to_pylist()]
                # Texts of blocks have no line ends, tags no spaces.
                lists = [pa.array([end.join([str(b[i]) for b in found]) for found in every], pa.string()) for i, end in enumerate(("", " ", "\n"))]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), *lists], ["host", "part", "page_id", "url", "kinds", "tags", "texts"])

    parsed = bound_batches(rows).select("host", "part", "page_id", "url", "html").mapInArrow(parse, f"host string, part long, page_id {kind}, url {address}, kinds string, tags string, texts string")
    # The runs of a host go to each of its parts and stand there before the pages.
    sent = found.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("is_page"), "runs")
    both = parsed.withColumn("is_page", F.lit(1)).unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("host", "part").sortWithinPartitions("host", "part", "is_page")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, np.empty(0, np.uint64)
        def texts(batch: pa.RecordBatch, rows: list[int]) -> pa.RecordBatch:
            at = pa.array(rows)
            kinds, tags, lines = (batch.column(c).take(at).to_pylist() for c in (5, 6, 7))
            out = main_texts([list(zip(map(int, k), t.split(" "), x.split("\n"), strict=True)) if k else [] for k, t, x in zip(kinds, tags, lines, strict=True)], runs, run)
            columns = [pa.array([o[0] for o in out], pa.string()), *(pa.array(v, pa.int64()) for v in ([len(o[0]) for o in out], [o[1] for o in out], [o[2] for o in out]))]
            return pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(4).take(at), *columns], ["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"])

        for batch in batches:
            hosts, parts, is_page = (batch.column(i).to_pylist() for i in (0, 1, 2))
            rows: list[int] = []
            for i in range(len(batch)):
                if (hosts[i], parts[i]) != now or len(rows) >= 512:
                    if rows:
                        yield texts(batch, rows)
                        rows = []
                    if (hosts[i], parts[i]) != now:
                        now, runs = (hosts[i], parts[i]), np.empty(0, np.uint64)
                if is_page[i]:
                    rows.append(i)
                else:
                    runs = np.sort(batch.column(8)[i].values.to_numpy().view(np.uint64))
            if rows:
                yield texts(batch, rows)

    schema = f"page_id {kind}, url {address}, text string, n_chars long, n_repeated long, n_marked long"
    return dealt.select("host", "part", "is_page", "page_id", "url", "kinds", "tags", "texts", "runs").mapInArrow(clean, schema)
