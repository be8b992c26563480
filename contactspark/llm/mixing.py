"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's part of all words, at most ``CAP`` times what
the source has; what lies above is shared out again by weight until no target
is above its limit (water level, found on the table of sources). Each document
should be copied target / source size times: the whole part is certain, the rest
is a chance.

The chances are rounded dependently, in blocks of documents of one source. A block
is folded from its largest document down. The first is paired with as many of those
after it as it takes to settle it: up or down by its own chance, and what it gains or
loses in expected words they lose or gain, each as far as keeps its own chance's mean
and leaves it within 0 and 1; then the next open one is. One pass goes on to documents
not yet touched, and takes care of the largest; a sweep then comes back to those it left
open before smaller ones are touched. The few that are left are paired one by one: the pivotal method moves expected words from one
document to the other, in a direction drawn so that each chance keeps its mean, until
one of the two is 0 or 1; the other goes on. So each step keeps all means and the
block's expected words, and leaves one open document, as a rule one of the smallest.
These meet in blocks again, level by level, up to the source's root; every source goes
this way, however small. One in ``BLOCK`` documents enters a level later, one in
``BLOCK`` of those another one later, and so on. The root's open document is drawn by its chance. No task sees
more than a block, which is larger (up to ``LARGEST`` documents) where a source's
largest document needs more others to settle it.

One kind of document can't keep its mean and its source's target: one with more than a
``GIANT`` th of the words at a root, for which the smaller ones there don't suffice.
There the target counts: it goes the way that is nearer, and the others make up for it.

All draws are hashes of the document, so reruns agree.

Defined cases: a null text has size 0; null is a source of its own, last in
order; equal rows share one chance for each of them and their copies are dealt
evenly among them; documents of size 0 are drawn alone and take no words; a
source without words has target 0; an empty table gives an empty result; further
columns are kept and take part in the row's identity (maps by their JSON).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import cut, fresh, word_count

#: Weights by place in the order of sources, most copies of a document, documents in a block, draws' seed.
WEIGHTS, CAP, BLOCK, SEED = (1, 2, 3), 3, 64, 20
#: Documents in a block at most; how often its words should hold the source's largest document; documents that a sweep takes at a time; share of a root's words that makes a giant.
LARGEST, ROOM, FEW, GIANT = 4096, 4, 8, 32
#: Copies of one row that are written by one task, about.
COPIES = 4096
#: A chance this close to 0 or 1 is settled; it is far below what rounding of sums leaves.
NEAR = 1e-9
#: Sources up to which their table (a row each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (a row for each source, with source_size and whatever else) with number, weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    s = sizes.withColumn("number", number)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1))
    s = s.withColumn("_limit", cap * F.col("source_size"))
    level = Window.orderBy(F.col("_limit") / F.col("weight"), "number")
    everything = Window.partitionBy()
    s = s.withColumn("_all", F.sum("source_size").over(everything))
    s = s.withColumn("_before", F.coalesce(F.sum("_limit").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_weights", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_weights"))
    s = s.withColumn("_top", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level"))).over(everything))
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_top"), F.lit(0.0)) * F.col("weight"))
    return s.select(*sizes.columns, "number", "weight", target.alias("target"))


def _draw(key: str, level: int) -> str:
    return f"(xxhash64({key}.k1, {key}.k2, {level}, {SEED}) & 9007199254740991) / 9007199254740992D"


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pivot(items: str, kind: str, level: int) -> str:
    """SQL that folds an array of items (k1, k2, p, size, row), one against the next, to (cur, p, done): the item left open, its chance, and the others with their outcome."""
    up = f"{_draw('x', level)} * (w.into + w.out) < w.out"
    zero = f"named_struct('cur', cast(null as {kind}), 'p', 0D, 'done', cast(array() as array<struct<item:{kind},up:boolean>>))"
    settled = """if(g.up,
        named_struct('cur', x, 'p', greatest(0D, x.p - g.moved / x.size), 'done', concat(a.done, array(named_struct('item', a.cur, 'up', true)))),
        named_struct('cur', x, 'p', least(1D, x.p + g.moved / x.size), 'done', concat(a.done, array(named_struct('item', a.cur, 'up', false)))))"""
    passed = """if(g.up,
        named_struct('cur', a.cur, 'p', least(1D, a.p + g.moved / a.cur.size), 'done', concat(a.done, array(named_struct('item', x, 'up', false)))),
        named_struct('cur', a.cur, 'p', greatest(0D, a.p - g.moved / a.cur.size), 'done', concat(a.done, array(named_struct('item', x, 'up', true)))))"""
    first = "if(d.up, (1 - a.p) * a.cur.size <= x.p * x.size, a.p * a.cur.size <= (1 - x.p) * x.size)"
    step = _bind("named_struct('into', least((1 - a.p) * a.cur.size, x.p * x.size), 'out', least(a.p * a.cur.size, (1 - x.p) * x.size))", "w",
           _bind(f"named_struct('up', {up}, 'into', w.into, 'out', w.out)", "d",
           _bind(f"named_struct('up', d.up, 'moved', if(d.up, d.into, d.out), 'first', {first})", "g", f"if(g.first, {settled}, {passed})")))
    return f"aggregate({items}, {zero}, (a, x) -> if(a.cur is null, named_struct('cur', x, 'p', x.p, 'done', a.done), {step}))"


def _reset(item: str, p: str) -> str:
    return f"named_struct('k1', {item}.k1, 'k2', {item}.k2, 'p', {p}, 'size', {item}.size, 'row', {item}.row)"


#: What an item x may give or take, in words of an item of chance p0, so that its chance stays within 0 and 1 whichever way that goes.
_MOST = "x.size * least(x.p / (1 - p0), (1 - x.p) / p0)"


def _pass(items: str, kind: str, draw: int) -> str:
    """SQL that goes over an array of items, largest first, to (open, done): each open one in turn is settled by those after it."""
    nobody, none = f"cast(null as {kind})", f"cast(array() as array<{kind}>)"
    zero = f"named_struct('cur', {nobody}, 'left', 0D, 'up', false, 'open', {none}, 'done', cast(array() as array<struct<item:{kind},up:boolean>>))"
    begin = f"named_struct('cur', x, 'left', x.size, 'up', {_draw('x', draw)} < x.p, 'open', s.open, 'done', s.done)"
    kept = f"q between {NEAR} and 1 - {NEAR}"
    after = f"""named_struct('cur', if(s.left > t, s.cur, {nobody}), 'left', s.left - t, 'up', s.up,
        'open', if({kept}, concat(s.open, array({_reset('x', 'q')})), s.open),
        'done', concat(s.done, if({kept}, cast(array() as array<struct<item:{kind},up:boolean>>), array(named_struct('item', x, 'up', q > 0.5D))),
                               if(s.left > t, cast(array() as array<struct<item:{kind},up:boolean>>), array(named_struct('item', s.cur, 'up', s.up)))))"""
    step = _bind("s.cur.p", "p0", _bind(f"least({_MOST}, s.left)", "t", _bind("x.p + t / x.size * if(s.up, p0 - 1, p0)", "q", after)))
    # of the last one a part may be left
    moved = "if(s.up, 1 - (1 - s.cur.p) * s.left / s.cur.size, s.cur.p * s.left / s.cur.size)"
    end = _bind(moved, "q", f"""if({kept}, named_struct('open', concat(array({_reset('s.cur', 'q')}), s.open), 'done', s.done),
        named_struct('open', s.open, 'done', concat(s.done, array(named_struct('item', s.cur, 'up', q > 0.5D)))))""")
    return f"aggregate({items}, {zero}, (s, x) -> if(s.cur is null, {begin}, {step}), s -> if(s.cur is null, named_struct('open', s.open, 'done', s.done), {end}))"


def _giants(items: str, kind: str, draw: int) -> str:
    """SQL that takes the giants off an array of items, largest first, to (open, done)."""
    pairs = f"array<struct<item:{kind},up:boolean>>"
    enough = "if(up, p0 - 1, p0) * t * a.size / room / x.size"  # all give or take, by what they may
    nearer = "if(up, -x.p, 1 - x.p) * least(1D, coalesce(try_divide(if(up, (1 - p0) * a.size, p0 * a.size), able), 1D))"
    changed = f"transform(rest, x -> {_bind(_MOST, 't', _bind(f'x.p + if(room >= a.size, {enough}, {nearer})', 'q', _reset('x', 'q')))})"
    kept = f"x.p between {NEAR} and 1 - {NEAR}"
    split = f"""named_struct('open', filter(now, x -> {kept}),
        'done', concat(s.done, array(named_struct('item', a, 'up', up)), transform(filter(now, x -> not {kept}), x -> named_struct('item', x, 'up', x.p > 0.5D))))"""
    settle = _bind(f"if(room >= a.size, {_draw('a', draw)} < p0, p0 >= 0.5D)", "up",
             _bind("aggregate(rest, 0D, (w, x) -> w + if(up, x.p, 1 - x.p) * x.size)", "able", _bind(changed, "now", split)))
    step = _bind("element_at(s.open, 1)", "a", _bind("slice(s.open, 2, size(s.open))", "rest", _bind("a.p", "p0", _bind(f"aggregate(rest, 0D, (w, x) -> w + {_MOST})", "room", settle))))
    total = f"aggregate({items}, 0D, (w, x) -> w + x.size)"
    return _bind(total, "total", f"""aggregate(sequence(1, {GIANT}), named_struct('open', {items}, 'done', cast(array() as {pairs})),
        (s, i) -> if(size(s.open) < 2, s, if(element_at(s.open, 1).size * {GIANT} <= total, s, {step})))""")


def _settle(items: str, kind: str, draw: int) -> str:
    """SQL that goes over a short array of items, largest first, to (open, done): each in turn is settled by those after it, and open ones of these are next. What they don't suffice for stays open."""
    none, pairs = f"cast(array() as array<{kind}>)", f"array<struct<item:{kind},up:boolean>>"
    kept = f"q between {NEAR} and 1 - {NEAR}"
    share = _bind(f"least({_MOST}, c.left)", "t", _bind("x.p + t / x.size * if(up, p0 - 1, p0)", "q", f"""named_struct('left', c.left - t,
        'todo', if({kept}, concat(c.todo, array({_reset('x', 'q')})), c.todo),
        'done', if({kept}, c.done, concat(c.done, array(named_struct('item', x, 'up', q > 0.5D)))))"""))
    moved = f"aggregate(rest, named_struct('left', a.size, 'todo', {none}, 'done', concat(s.done, array(named_struct('item', a, 'up', up)))), (c, x) -> {share})"
    settle = _bind(f"{_draw('a', draw)} < p0", "up", _bind(moved, "m", "named_struct('todo', m.todo, 'open', s.open, 'done', m.done)"))
    wait = "named_struct('todo', rest, 'open', concat(s.open, array(a)), 'done', s.done)"
    room = f"aggregate(rest, 0D, (w, x) -> w + {_MOST})"
    step = _bind("element_at(s.todo, 1)", "a", _bind("slice(s.todo, 2, size(s.todo))", "rest", _bind("a.p", "p0", f"if({room} >= a.size, {settle}, {wait})")))
    start = f"named_struct('todo', {items}, 'open', {none}, 'done', cast(array() as {pairs}))"
    return f"aggregate(sequence(1, size({items})), {start}, (s, i) -> if(size(s.todo) = 0, s, {step}), s -> named_struct('open', s.open, 'done', s.done))"


def _sweep(items: str, kind: str, draw: int) -> str:
    """``_settle`` for an array of any length: a few items at a time, and with them those that the ones before left open."""
    start = f"named_struct('open', cast(array() as array<{kind}>), 'done', cast(array() as array<struct<item:{kind},up:boolean>>))"
    few = f"concat(r.open, slice({items}, {FEW} * g + 1, {FEW}))"
    step = _bind(few, "few", _bind(_settle("few", kind, draw), "n", "named_struct('open', n.open, 'done', concat(r.done, n.done))"))
    return f"if(size({items}) = 0, {start}, aggregate(sequence(0, (size({items}) - 1) div {FEW}), {start}, (r, g) -> {step}))"


def fold(items: str, kind: str, level: int, root: str) -> str:
    """SQL that folds an array of items, largest first, to (cur, p, done): at most one item stays open. ``root``: SQL for whether the block is a root."""
    draw, start = 10 * level, f"named_struct('open', {items}, 'done', cast(array() as array<struct<item:{kind},up:boolean>>))"
    then = lambda before, rest: f"named_struct({rest}, 'done', concat({before}.done, f.done))"
    out = _bind(_pivot("b2.open", kind, draw + 3), "f", then("b2", "'cur', f.cur, 'p', f.p"))
    for k, step in ((2, _sweep), (1, _pass)):
        out = _bind(_bind(step(f"b{k - 1}.open", kind, draw + k), "f", then(f"b{k - 1}", "'open', f.open")), f"b{k}", out)
    return _bind(f"if({root}, {_giants(items, kind, draw)}, {start})", "b0", out)


def identity(docs: DataFrame) -> list[Column]:
    """Two longs that tell rows apart by all of their columns."""
    columns = [(F.col(f"`{f.name}`"), "map<" in f.dataType.simpleString()) for f in docs.schema]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c, _ in columns])
    hashed = [F.to_json(F.struct(c.alias("c"))) if mapped else c for c, mapped in columns]
    return [F.xxhash64(F.lit(k), nulls, *hashed) for k in (1, 2)]


def plan(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """A row for each distinct row of ``docs``: k1, k2, row (struct of the columns in ``carry``, as c0, c1 and so on), source, size, n_rows, source_size, target, copies (over all n_rows)."""
    k1, k2 = identity(docs)
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]) if carry else F.struct(F.lit(0).alias("none"))
    units = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("source"), word_count(F.col("text")).alias("size"), held.alias("row"))
    units = cut(units.groupBy("k1", "k2").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.first("row").alias("row"), F.count("*").alias("n_rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_units"), F.sum("size").alias("words"), F.max("size").alias("most"))
    needed = F.least(F.greatest(F.ceil(F.lit(ROOM) * F.col("most") * F.col("n_units") / F.greatest("words", F.lit(1))), F.lit(block)), F.lit(max(block, LARGEST)))
    sizes = sizes.select("source", "source_size", "n_units", F.ceil(F.col("n_units") / needed).alias("n_blocks"))
    sizes = sizes.withColumn("levels", 1 + F.ceil(F.ln("n_blocks") / math.log(block)))
    sources = cut(targets(sizes, weights, cap))
    n_sources, levels = sources.agg(F.count("*"), F.coalesce(F.max("levels"), F.lit(0))).first()
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    u = units.alias("u").join(side.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", "s.source_size", "s.target", "s.number", "s.n_blocks", "s.levels")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n_rows")).otherwise(F.lit(0.0))
    u = u.withColumn("_times", times).withColumn("_whole", F.floor("_times")).withColumn("p", F.col("_times") - F.col("_whole"))
    row = F.struct("row", "source", F.col("size").alias("size"), "n_rows", "source_size", "target", F.col("_whole").alias("whole"))
    item = F.struct("k1", "k2", "p", F.col("size").cast("double").alias("size"), row.alias("row"))
    items = u.select(item.alias("item"), "number", "levels", F.pmod("k1", F.col("n_blocks")).alias("block"))
    # one in so many documents enters at a higher level, so that blocks there hold documents of all sizes
    enter = 1 + F.floor(-F.ln(F.greatest(F.expr(_draw("item", -1)), F.lit(1e-300))) / math.log(block))
    items = items.withColumn("enter", F.least(enter, F.col("levels")))
    alone = (F.col("item.size") <= 0) | ~F.col("item.p").between(NEAR, 1 - NEAR)
    settled = [items.where(alone).select("item", F.expr(f"{_draw('item', 0)} < item.p").alias("up"))]
    kind = items.schema["item"].dataType.simpleString()

    open_ = F.col("f.p").between(NEAR, 1 - NEAR)
    reopened = F.struct(*[F.col("f.p").alias("p") if c == "p" else F.col(f"f.cur.{c}").alias(c) for c in ("k1", "k2", "p", "size", "row")])
    place = ["number", "levels", "block"]
    left = None
    for level in range(1, levels + 1):
        todo = items.where(~alone & (F.col("enter") == level)).select("item", "number", "levels", F.floor(F.col("block") / block ** (level - 1)).alias("block"))
        if left is not None:
            todo = todo.unionByName(left.where(F.col("levels") >= level).select(reopened.alias("item"), "number", "levels", F.floor(F.col("block") / block).alias("block")))
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("by"), "item")))
        folded = todo.groupBy(*place).agg(F.transform(ordered, lambda x: x["item"]).alias("items"))
        folded = cut(folded.select(*place, F.expr(fold("items", kind, level, f"levels = {level}")).alias("f")))
        settled.append(folded.select(F.explode("f.done").alias("d")).select("d.item", "d.up"))
        left = folded.where("f.cur is not null")
        settled.append(left.where(~open_).select(F.col("f.cur").alias("item"), (F.col("f.p") > 0.5).alias("up")))
        left = left.where(open_)
        last = left.where(F.col("levels") == level).select(reopened.alias("item"))
        settled.append(last.select("item", F.expr(f"{_draw('item', 10 * level + 9)} < item.p").alias("up")))

    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.col("item.row.whole") + F.col("up").cast("long")
    return out.select("item.k1", "item.k2", "item.row.row", "item.row.source", F.col("item.row.size").alias("size"), "item.row.n_rows", "item.row.source_size", "item.row.target", copies.alias("copies"))


def _share(i: Column) -> Column:
    """Copies of the i-th (from 0) of n_rows equal rows."""
    return F.floor(F.col("copies") / F.col("n_rows")) + (i < F.col("copies") % F.col("n_rows")).cast("long")


def _often(rows: DataFrame, times: str, name: str) -> DataFrame:
    """``rows``, each as often as ``times`` says, numbered in ``name`` from 0; one that many copies are made of is dealt in parts first."""
    part, times = fresh(rows, "_part"), F.col(times)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = rows.where(times.between(1, COPIES)).withColumn(name, upto(times))
    many = rows.where(times > COPIES).withColumn(part, upto(F.ceil(times / COPIES)))
    many = many.repartition(part).withColumn(name, F.explode(F.sequence(F.col(part) * COPIES, F.least((F.col(part) + 1) * COPIES, times) - 1))).drop(part)
    return few.unionByName(many)


def digest(docs: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each row of ``docs``: the columns in ``carry``, size, source_size, target, copies and taken."""
    p = _often(plan(docs, carry), "n_rows", "i")
    p = p.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)], "size", "source_size", "target", _share(F.col("i")).alias("copies"))
    return p.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``. Equal rows are one row until they are written."""
    k1, k2 = identity(docs)
    p = plan(docs).where("copies > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "copies")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), k1.alias("_k1"), k2.alias("_k2"))
    held = held.groupBy("_k1", "_k2").agg(F.first("_doc").alias("_doc")).join(p, ["_k1", "_k2"])
    return _often(held, "copies", "_i").select("_doc.*")
