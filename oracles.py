"""SQL equivalents of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

# Parameters shared by the queries and their SQL.
WIDTH = 4
PUBLISHED_WIDTH = 128
SGD_WIDTH = 2
RATE = 0.02
SGD_RATE = 0.01
ADAPTIVE_RATE = 0.1
PENALTY = 0.05
SEED = 13
BLOCKS = 8
RECORDS_PER_PART = 2000
BATCHES = 3
BATCH_SIZE = 1000
HOT_ROWS = 1000
# A table of runs: what they share, what each changes, and the errors at which they stop.
RUN_COMMON = {"regularization_factor": 0.05, "max_num_iterations": 2, "precision": 2, "show_test_rmse": 1}
RUNS = {"slow": {"gd_mode": 0, "num_features": 4, "learning_rate": 0.01},
        "fast": {"gd_mode": 0, "num_features": 4, "learning_rate": 0.03},
        "wide": {"gd_mode": 0, "num_features": 6, "learning_rate": 0.02},
        "adaptive": {"gd_mode": 2, "num_features": 2, "learning_rate": 0.1}}
RUN_TARGETS = {"slow": 3.25, "fast": 3.25, "adaptive": 3.0}

RATINGS = """ratings AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1
           AS rec_id,
         CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
         CAST(1 + (CAST(l_quantity AS BIGINT) - 1) % 5 AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
train AS (SELECT * FROM ratings WHERE rec_id % 10 <> 0),
test AS (SELECT * FROM ratings WHERE rec_id % 10 = 0)"""


def _double(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def _initial(source: str, width: int, name: str = "state") -> str:
    """Initial factor rows ``(side, id, f)`` sized by the ids of ``source``."""
    parts = []
    for side, column, salt in ((0, "user_id", 1), (1, "item_id", 2)):
        parts.append(
            f"SELECT {side} AS side, CAST(id AS INT) AS id, list_transform(range({width}), lambda k: "
            f"((id * 7919 + k * 104729 + {salt} * 1299709) % 10007) / CAST(100070 AS DOUBLE)) AS f "
            f"FROM (SELECT unnest(range((SELECT max({column}) + 1 FROM {source}))) AS id)")
    return f"{name} AS (\n  {' UNION ALL '.join(parts)})"


def _dot(left: str, right: str, width: int) -> str:
    return " + ".join(f"{left}[{k}] * {right}[{k}]" for k in range(1, width + 1))


def _scored(records: str, state: str, width: int, name: str) -> str:
    return (f"{name} AS (SELECT r.*, u.f AS p, v.f AS q, {_dot('u.f', 'v.f', width)} AS prediction,\n"
            f"  {_dot('u.f', 'v.f', width)} - r.rating AS e FROM {records} r\n"
            f"  JOIN {state} u ON u.side = 0 AND u.id = r.user_id JOIN {state} v ON v.side = 1 AND v.id = r.item_id)")


def _gradient(scored: str, width: int, name: str) -> str:
    sides = []
    for side, column, other in ((0, "user_id", "q"), (1, "item_id", "p")):
        sums = ", ".join(f"sum(e * {other}[{k}])" for k in range(1, width + 1))
        sides.append(f"SELECT {side} AS side, {column} AS id, [{sums}] AS g FROM {scored} GROUP BY {column}")
    return f"{name} AS ({' UNION ALL '.join(sides)})"


def _stepped(state: str, gradient: str, width: int, rate: float, name: str) -> str:
    moved = ", ".join(f"s.f[{k}] - {_double(rate)} * (g.g[{k}] + {_double(PENALTY)} * s.f[{k}])"
                      for k in range(1, width + 1))
    return (f"{name} AS (SELECT s.side, s.id, CASE WHEN g.g IS NULL THEN s.f ELSE [{moved}] END AS f\n"
            f"  FROM {state} s LEFT JOIN {gradient} g ON g.side = s.side AND g.id = s.id)")


def _descent(records: list[str], width: int, rate: float, tag: str = "") -> str:
    """One step per entry of ``records``, from ``state`` to ``state<n><tag>``."""
    steps = []
    before = "state"
    for n, source in enumerate(records, 1):
        steps += [_scored(source, before, width, f"scored{n}{tag}"),
                  _gradient(f"scored{n}{tag}", width, f"gradient{n}{tag}"),
                  _stepped(before, f"gradient{n}{tag}", width, rate, f"state{n}{tag}")]
        before = f"state{n}{tag}"
    return ",\n".join(steps)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((RATINGS, *parts)) + "\n"


def _exploded(state: str, width: int, column: str = "f", side: str = "side, ") -> str:
    return (f"SELECT {side}id, CAST(k - 1 AS INT) AS k, round({column}[k], 6) AS value\n"
            f"FROM {state}, (SELECT unnest(range(1, {width + 1})) AS k)")


def _rmse(records: str, state: str, width: int = WIDTH) -> str:
    return (f"(SELECT sqrt(avg(power({_dot('u.f', 'v.f', width)} - r.rating, 2))) FROM {records} r\n"
            f"  JOIN {state} u ON u.side = 0 AND u.id = r.user_id JOIN {state} v ON v.side = 1 AND v.id = r.item_id)")


def _order(key: str) -> str:
    return f"({key} * 7919 + {SEED}) % 10007, {key}"


def _half(x: str) -> str:
    """Nearest binary16 value of a FLOAT expression."""
    spacing = (f"power(CAST(2 AS DOUBLE), greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10)")
    return f"CASE WHEN {x} = 0 THEN {x} ELSE CAST(round_even({x} / {spacing}, 0) * {spacing} AS FLOAT) END"


def _fold(adaptive: bool, half: bool, rate: float) -> str:
    """Lambda of a fold over records ``{u, v, r, p, q[, a, c]}``: one descent step on flat state lists.

    ``p``, ``q`` are factors, ``a``, ``c`` squared-gradient sums. Each stage of the step is a
    one-element list, so that every value is computed once.
    """
    kind = "FLOAT" if half else "DOUBLE"
    lists = "pqac" if adaptive else "pq"
    ids = {"p": "u", "a": "u", "q": "v", "c": "v"}
    width = range(1, SGD_WIDTH + 1)
    lr, lam = f"CAST({rate} AS {kind})", f"CAST({PENALTY} AS {kind})"
    read = ", ".join(f"'{n}{k}': s.{n}[{SGD_WIDTH} * x.{ids[n]} + {k}]" for n in lists for k in width)
    keep = ", ".join(f"'{n}{k}': t.{n}{k}" for n in lists for k in width)
    error = f"CAST({' + '.join(f't.p{k} * t.q{k}' for k in width)} - x.r AS {kind})"
    keep_more = ", ".join(f"'{n}{k}': t.{n}{k}" for n in lists for k in width)
    slopes = ", ".join(f"'gp{k}': {lam} * t.p{k} + t.e * t.q{k}, 'gq{k}': {lam} * t.q{k} + t.e * t.p{k}" for k in width)
    stages = [f"[{{{read}}}]", f"{{{keep}, 'e': {error}}}", f"{{{keep_more}, {slopes}}}"]
    if adaptive:
        sums = ", ".join(f"'h{n}{k}': t.{a}{k} + t.g{n}{k} * t.g{n}{k}" for n, a in (("p", "a"), ("q", "c"))
                         for k in width)
        stages.append(f"{{{keep}, {', '.join(f"'g{n}{k}': t.g{n}{k}" for n in 'pq' for k in width)}, {sums}}}")
        move = "CASE WHEN t.h{0} > 0 THEN {1} / CAST(sqrt(t.h{0}) AS {2}) * t.g{0} ELSE 0 END"
        steps = {n: [f"t.{n}{k} - {move.format(f'{n}{k}', lr, kind)}" for k in width] for n in "pq"}
        steps |= {"a": [f"t.hp{k}" for k in width], "c": [f"t.hq{k}" for k in width]}
    else:
        steps = {n: [f"t.{n}{k} - {lr} * t.g{n}{k}" for k in width] for n in "pq"}
    stages.append("{" + ", ".join(f"'{n}{k}': {e}" for n in lists for k, e in zip(width, steps[n])) + "}")
    if half:
        stages.append("{" + ", ".join(f"'{n}{k}': {_half(f't.{n}{k}')}" for n in lists for k in width) + "}")
    chain = stages[0]
    for stage in stages[1:]:
        chain = f"list_transform({chain}, lambda t: {stage})"
    written = ", ".join(
        f"'{n}': list_concat(list_concat(s.{n}[:{SGD_WIDTH} * x.{ids[n]}], "
        f"[{', '.join(f't.{n}{k}' for k in width)}]), s.{n}[{SGD_WIDTH} * x.{ids[n]} + {SGD_WIDTH + 1}:])" for n in lists)
    return f"lambda s, x: list_transform({chain}, lambda t: {{'u': x.u, 'v': x.v, 'r': x.r, {written}}})[1]"


def _fold_batches(rate: float) -> str:
    """Lambda of a fold over batches ``{l, p, q}``: each row of the batch moves once by its summed gradient."""
    error = " + ".join(f"s.p[{SGD_WIDTH} * t.u + {k}] * s.q[{SGD_WIDTH} * t.v + {k}]" for k in range(1, SGD_WIDTH + 1))
    scored = f"list_transform(x.l, lambda t: {{'u': t.u, 'v': t.v, 'e': {error} - t.r}})"

    def moved(own: str, own_id: str, other: str, other_id: str) -> str:
        mine = f"list_filter(w.l, lambda t: t.{own_id} = (j - 1) // {SGD_WIDTH})"
        slope = (f"list_sum(list_transform({mine}, lambda t: "
                 f"t.e * w.{other}[{SGD_WIDTH} * t.{other_id} + (j - 1) % {SGD_WIDTH} + 1]))")
        return (f"list_transform(w.{own}, lambda y, j: coalesce(y - {_double(rate)} * ({slope} "
                f"+ {_double(PENALTY)} * y), y))")

    return (f"lambda s, x: list_transform([{{'l': {scored}, 'p': s.p, 'q': s.q}}], lambda w: "
            f"{{'l': x.l, 'p': {moved('p', 'u', 'q', 'v')}, 'q': {moved('q', 'v', 'p', 'u')}}})[1]")


def _element(u: str, v: str, r: str, adaptive: bool, kind: str, state: dict[str, str] | None = None) -> str:
    lists = "pqac" if adaptive else "pq"
    values = {n: (state or {}).get(n, f"CAST(NULL AS {kind}[])") for n in lists}
    parts = ", ".join(f"'{n}': {e}" for n, e in values.items())
    return f"{{'u': CAST({u} AS BIGINT), 'v': CAST({v} AS BIGINT), 'r': CAST({r} AS {kind}), {parts}}}"


def _sequential(adaptive: bool, half: bool, rate: float, epochs: int = 1, trace: bool = False,
                batch: int | None = None) -> str:
    """Serial descent in (stratum, block, position) order: per stratum, one fold for each block.

    Gives the factors after the last epoch, or with ``trace`` the errors after each. With ``batch``
    the folds run over batches of that many consecutive records of a block.
    """
    kind = "FLOAT" if half else "DOUBLE"
    rounded = _half("CAST(x AS FLOAT)") if half else "x"
    block = "{0} * 1299709 % 2147483647 % " + str(BLOCKS)
    parts = [
        "indexed AS (SELECT side, id, f, blk, row_number() OVER (PARTITION BY side, blk ORDER BY id) - 1 AS idx\n"
        f"  FROM (SELECT *, {block.format('CAST(id AS BIGINT)')} AS blk FROM state))",
        f"placed AS (SELECT u.blk AS b, (v.blk - u.blk + {BLOCKS}) % {BLOCKS} AS stratum, u.idx AS u, v.idx AS v,\n"
        f"    r.rating AS r, row_number() OVER (ORDER BY {_order('rec_id')}) AS pos FROM train r\n"
        "  JOIN indexed u ON u.side = 0 AND u.id = user_id JOIN indexed v ON v.side = 1 AND v.id = item_id)",
        f"recs AS (SELECT stratum, b, list({_element('u', 'v', 'r', adaptive, kind)} ORDER BY pos) AS l\n"
        "  FROM placed GROUP BY stratum, b)",
        f"start AS (SELECT side, blk AS b, flatten(list(list_transform(f, lambda x: {rounded}) ORDER BY idx)) AS f,\n"
        f"  flatten(list(list_transform(f, lambda x: CAST(0 AS {kind})) ORDER BY idx)) AS z FROM indexed GROUP BY side, blk)",
        "users0 AS (SELECT b, f AS p, z AS a FROM start WHERE side = 0)",
        "items0 AS (SELECT b, f AS q, z AS c FROM start WHERE side = 1)"]
    fold, first = _fold(adaptive, half, rate), _element("0", "0", "0", adaptive, kind, dict(zip("pqac", "pqac")))
    if batch:
        record = "STRUCT(u BIGINT, v BIGINT, r DOUBLE)[]"
        whole = "{{'l': {}, 'p': {}, 'q': {}}}".format
        fold, first = _fold_batches(rate), whole(f"CAST([] AS {record})", "p", "q")
        empty = "CAST(NULL AS DOUBLE[])"
        parts[2] = (
            f"recs AS (SELECT stratum, b, list({whole('r', empty, empty)} ORDER BY n) AS l FROM (\n"
            f"    SELECT stratum, b, n, CAST(list({{'u': u, 'v': v, 'r': r}} ORDER BY pos) AS {record}) AS r FROM (\n"
            f"      SELECT *, (row_number() OVER (PARTITION BY stratum, b ORDER BY pos) - 1) // {batch} AS n FROM placed)\n"
            "    GROUP BY stratum, b, n) GROUP BY stratum, b)")
    more_user, more_item = (", z.a", ", z.c") if adaptive else ("", "")
    for n in range(BLOCKS * epochs):
        parts += [
            f"fold{n} AS MATERIALIZED (SELECT users{n}.b AS ub, items{n}.b AS ib,\n"
            f"    list_reduce(coalesce(l, []), {fold},\n"
            f"      {first}) AS z\n"
            f"  FROM users{n} JOIN items{n} ON items{n}.b = (users{n}.b + {n % BLOCKS}) % {BLOCKS}\n"
            f"  LEFT JOIN recs ON recs.stratum = {n % BLOCKS} AND recs.b = users{n}.b)",
            f"users{n + 1} AS (SELECT ub AS b, z.p AS p{more_user} FROM fold{n})",
            f"items{n + 1} AS (SELECT ib AS b, z.q AS q{more_item} FROM fold{n})"]
    for epoch in range(1, epochs + 1):
        last = BLOCKS * epoch
        values = ", ".join(f"CAST(d.f[{SGD_WIDTH} * idx + {k}] AS DOUBLE)" for k in range(1, SGD_WIDTH + 1))
        parts.append(f"state{epoch} AS (SELECT i.side, i.id, [{values}] AS f FROM indexed i JOIN (\n"
                     f"  SELECT 0 AS side, b, p AS f FROM users{last} UNION ALL SELECT 1, b, q FROM items{last}) d\n"
                     "  ON d.side = i.side AND d.b = i.blk)")
    begin = _with(_initial("train", SGD_WIDTH), *parts)
    if not trace:
        return begin + _exploded(f"state{epochs}", SGD_WIDTH)
    return begin + " UNION ALL ".join(
        f"SELECT CAST({n} AS INT) AS iter, round({_rmse('train', name, SGD_WIDTH)}, 6) AS train_rmse, "
        f"round({_rmse('test', name, SGD_WIDTH)}, 6) AS test_rmse"
        for n, name in enumerate(["state", *(f"state{e}" for e in range(1, epochs + 1))]))


def _parallel(placed: str, *before: str) -> str:
    """Serial descent inside each part, then the record-weighted mean of each row's copies.

    ``placed`` has ``part, user_id, item_id, rating, pos``.
    """
    state = {"p": "p", "q": "q"}
    values = ", ".join(f"sum(n * z[{SGD_WIDTH} * id + {k}]) / sum(n)" for k in range(1, SGD_WIDTH + 1))
    parts = [
        *before, f"placed AS ({placed})",
        f"recs AS (SELECT part, list({_element('user_id', 'item_id', 'rating', False, 'DOUBLE')} ORDER BY pos) AS l\n"
        "  FROM placed GROUP BY part)",
        "start AS (SELECT flatten(list(f ORDER BY id) FILTER (WHERE side = 0)) AS p,\n"
        "  flatten(list(f ORDER BY id) FILTER (WHERE side = 1)) AS q FROM state)",
        f"folded AS MATERIALIZED (SELECT part, list_reduce(l, {_fold(False, False, SGD_RATE)},\n"
        f"    {_element('0', '0', '0', False, 'DOUBLE', state)}) AS z FROM recs, start)",
        "copies AS (SELECT 0 AS side, user_id AS id, n, z.p AS z FROM folded\n"
        "    JOIN (SELECT part, user_id, count(*) AS n FROM placed GROUP BY part, user_id) USING (part)\n"
        "  UNION ALL SELECT 1, item_id, n, z.q FROM folded\n"
        "    JOIN (SELECT part, item_id, count(*) AS n FROM placed GROUP BY part, item_id) USING (part))",
        f"moved AS (SELECT side, id, [{values}] AS f FROM copies GROUP BY side, id)",
        "merged AS (SELECT s.side, s.id, coalesce(m.f, s.f) AS f FROM state s LEFT JOIN moved m\n"
        "  ON m.side = s.side AND m.id = s.id)"]
    return _with(_initial("train", SGD_WIDTH), *parts) + _exploded("merged", SGD_WIDTH)


def _run_table() -> tuple[str, str, str]:
    """The table of runs, its traces, and the epochs that reach the targets."""
    defaults = {"gd_mode": 2, "batch_size": 1, "num_features": 128, "learning_rate": 0.1, "regularization_factor": 0.05,
                "max_num_iterations": 70, "decomp_mode": 2, "lock": 0, "precision": 0, "show_train_rmse": 0,
                "show_test_rmse": 0}
    rows, traces = [], []
    for name, values in RUNS.items():
        given = {**defaults, **RUN_COMMON, **values}
        columns = ", ".join(f"{_double(v) if isinstance(v, float) else f'CAST({v} AS INT)'} AS {k}" for k, v in given.items())
        rows.append(f"SELECT '{name}' AS run, {columns}")
        if given["gd_mode"] == 2:
            traces.append(f"SELECT '{name}' AS run, iter, test_rmse FROM (\n"
                          f"{_sequential(True, False, given['learning_rate'], epochs=2, trace=True)})")
            continue
        width, states = given["num_features"], ("state", "state1", "state2")
        steps = [f"SELECT '{name}' AS run, CAST({n} AS INT) AS iter, round({_rmse('test', s, width)}, 6) AS test_rmse"
                 for n, s in enumerate(states)]
        traces.append(f"SELECT * FROM (\n{_with(_initial('train', width), _descent(['train'] * 2, width, given['learning_rate']))}"
                      + " UNION ALL ".join(steps) + ")")
    goals = " UNION ALL ".join(f"SELECT '{name}' AS run, {_double(goal)} AS target_rmse" for name, goal in RUN_TARGETS.items())
    table = (_with(f"runs AS ({' UNION ALL '.join(rows)})", """size AS (
  SELECT max(user_id) + 1 AS num_users, max(item_id) + 1 AS num_items, count(*) AS num_records FROM train)""")
             + "SELECT runs.*, num_records, CAST(ceil(num_records / batch_size) AS BIGINT) AS batches,\n"
             "  CAST((num_users + num_items) * num_features AS BIGINT) AS factor_values FROM runs, size")
    ended = (f"WITH traces AS ({' UNION ALL '.join(traces)}), targets AS ({goals}),\n"
             "reached AS (SELECT run, min(target_rmse) AS target_rmse, CAST(min(iter) FILTER (WHERE test_rmse <= target_rmse) AS INT)\n"
             "  AS epochs FROM traces JOIN targets USING (run) GROUP BY run)\n")
    return (table, ended + "SELECT traces.* FROM traces LEFT JOIN reached USING (run) WHERE iter <= coalesce(epochs, iter)",
            ended + "SELECT run AS dataset, target_rmse, epochs FROM reached")


def _parity(width: int) -> str:
    """Draws ``id * width + k + 1`` of the minimal standard generator, by modular powers."""
    modulus = 2147483647
    powers = ", ".join(str(pow(16807, 1 << bit, modulus)) for bit in range(40))
    draw = (f"list_reduce(list_transform(range(40), lambda j: CASE WHEN (n >> CAST(j AS INT)) & 1 = 1 THEN CAST(([{powers}])[j + 1] AS BIGINT)"
            f" ELSE CAST(1 AS BIGINT) END), lambda a, b: a * b % {modulus})")
    value = (f"CAST(CAST(least(CAST(CAST({draw} - 1 AS FLOAT) AS DOUBLE) / 2147483648, 1 - power(2, -24)) AS DOUBLE)"
             " * CAST(CAST(0.1 AS FLOAT) AS DOUBLE) AS FLOAT)")
    return (_with(_initial("ratings", width), f"places AS (SELECT side, id, CAST(k AS INT) AS k, CAST(id AS BIGINT) * {width} + k + 1 AS n\n"
                  f"  FROM state, (SELECT unnest(range({width})) AS k))")
            + f"SELECT side, id, k, round(CAST({value} AS DOUBLE), 10) AS value FROM places")


def _bijective(source: str, key: str, seed: int, rounds: int = 4, walks: int = 4) -> str:
    """Feistel rounds on a grid of barely more cells than ids; ids that land beyond walk on."""
    keys = [(seed * 1299709 + n * 104729) % 2147483647 for n in range(1, 2 * rounds + 1)]

    def mixed(half: str, number: int) -> str:
        once = f"(({half}) % 2147483647 * 7919 + {number}) % 2147483647"
        return f"(({once}) * ({once}) + {number}) % 2147483647"

    parts = [f"size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (\n"
             f"  SELECT max({key}) + 1 AS n FROM {source})))",
             f"walk0 AS (SELECT {key}, {key} AS cell, n, a, b FROM {source}, size)"]
    for walk in range(walks):
        parts.append(f"turn{walk}_0 AS (SELECT {key}, cell AS before, cell // b AS l, cell % b AS r, n, a, b FROM walk{walk})")
        for k in range(rounds):
            parts.append(f"half{walk}_{k} AS (SELECT {key}, before, (l + {mixed('r', keys[2 * k])}) % a AS l, r, n, a, b FROM turn{walk}_{k})")
            parts.append(f"turn{walk}_{k + 1} AS (SELECT {key}, before, l, (r + {mixed('l', keys[2 * k + 1])}) % b AS r, n, a, b FROM half{walk}_{k})")
        kept = "l * b + r" if walk == 0 else "CASE WHEN before < n THEN before ELSE l * b + r END"
        parts.append(f"walk{walk + 1} AS (SELECT {key}, {kept} AS cell, n, a, b FROM turn{walk}_{rounds})")
    return _with(*parts) + f"SELECT {key}, CAST(cell AS BIGINT) AS pos FROM walk{walks}"


def statements() -> dict[str, str]:
    sql = {}
    for scan in ("scan_coo_text", "scan_coo_text_one_based", "scan_coo_binary", "scan_coo_binary_wide"):
        sql[scan] = _with() + "SELECT * FROM ratings"
    sql["scan_coo_binary_range"] = _with() + (
        "SELECT * FROM ratings WHERE rec_id BETWEEN (SELECT count(*) FROM ratings) // 5 AND (SELECT count(*) FROM ratings) // 2")
    sql["check_ratings"] = _with() + """, size AS (
  SELECT max(user_id) + 1 AS num_users, max(item_id) + 1 AS num_items, count(*) AS num_records FROM train),
counted AS (
  SELECT count(*) AS records,
    count(*) FILTER (WHERE user_id IS NULL OR item_id IS NULL) AS bad_null_ids,
    count(*) FILTER (WHERE rating IS NULL) AS bad_null_ratings,
    count(*) FILTER (WHERE user_id < 0) AS bad_negative_users,
    count(*) FILTER (WHERE item_id < 0) AS bad_negative_items,
    count(*) FILTER (WHERE user_id >= (SELECT num_users FROM size)) AS bad_large_users,
    count(*) FILTER (WHERE item_id >= (SELECT num_items FROM size)) AS bad_large_items,
    (SELECT num_records FROM size) - count(*) AS bad_missing_records,
    CAST(0 AS BIGINT) AS surplus_records
  FROM ratings)
SELECT *, bad_null_ids + bad_null_ratings + bad_negative_users + bad_negative_items + bad_large_users
  + bad_large_items + abs(bad_missing_records) = 0 AS valid FROM counted"""
    sql["rebase_ids"] = _with() + (
        "SELECT rec_id, CAST(user_id - 1 AS INT) AS user_id, CAST(item_id - 1 AS INT) AS item_id, rating FROM ratings")
    start = _initial("ratings", WIDTH)
    trained = _initial("train", WIDTH)
    sql["init_factors"] = _with(start) + _exploded("state", WIDTH)
    sql["predict"] = _with(start, _scored("ratings", "state", WIDTH, "scored")) + (
        "SELECT rec_id, round(prediction, 6) AS prediction FROM scored")
    sql["residuals"] = _with(start, _scored("ratings", "state", WIDTH, "scored")) + (
        "SELECT rec_id, round(e, 6) AS residual FROM scored")
    sql["quantize_half"] = """WITH items AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS k FROM embeddings),
grid AS (SELECT *, power(CAST(2 AS DOUBLE), CASE WHEN abs(x) < power(CAST(2 AS DOUBLE), -14) THEN -24
                   ELSE floor(log2(abs(x))) - 10 END) AS q FROM items)
SELECT vec_id, CAST(k AS INT) AS k, CASE WHEN x = 0 THEN x ELSE round_even(x / q, 0) * q END AS value FROM grid"""
    sql["export_factors"] = _with(start) + (
        "SELECT side, id, array_to_string(list_transform(f, lambda x: printf('%10.2g', CAST(x AS FLOAT)) || ' '), '')"
        " AS line FROM state")
    sql["square_error_sum"] = _with(start, _scored("ratings", "state", WIDTH, "scored")) + (
        "SELECT round(sum(e * e), 4) AS square_error_sum, count(*) AS num_records FROM scored")
    for records in ("train", "test"):
        sql[f"{records}_rmse"] = _with(trained) + f"SELECT round({_rmse(records, 'state')}, 6) AS {records}_rmse"
    first = (_scored("train", "state", WIDTH, "scored"), _gradient("scored", WIDTH, "gradient"))
    for side, name in ((0, "user_gradients"), (1, "item_gradients")):
        sql[name] = _with(trained, *first) + _exploded("gradient", WIDTH, "g", "") + f" WHERE side = {side}"
    sql["gd_epoch"] = _with(trained, _descent(["train"], WIDTH, RATE)) + _exploded("state1", WIDTH)
    sql["gd_epoch_grid"] = sql["gd_epoch"]
    sql["predict_grid"] = sql["predict"]
    wide = PUBLISHED_WIDTH
    sql["predict_wide"] = _with(_initial("ratings", wide), _scored("ratings", "state", wide, "scored")) + (
        "SELECT rec_id, round(prediction, 6) AS prediction FROM scored")
    sql["gd_epoch_wide"] = _with(_initial("train", wide), _descent(["train"], wide, RATE)) + _exploded("state1", wide)
    skewed = ("skewed AS (SELECT rec_id, rating, CASE WHEN rec_id % 2 = 0 THEN 0 ELSE user_id END AS user_id,\n"
              "  CASE WHEN rec_id % 3 = 0 THEN 0 ELSE item_id END AS item_id FROM {})")
    sql["predict_skewed"] = _with(skewed.format("ratings"), _initial("skewed", WIDTH),
                                  _scored("skewed", "state", WIDTH, "scored")) + (
        "SELECT rec_id, round(prediction, 6) AS prediction FROM scored")
    sql["gd_epoch_grid_skewed"] = _with(skewed.format("train"), _initial("skewed", WIDTH),
                                        _descent(["skewed"], WIDTH, RATE)) + _exploded("state1", WIDTH)
    sql["predict_trained"] = _with(trained, _descent(["train"] * 2, WIDTH, RATE),
                                   _scored("test", "state2", WIDTH, "scored")) + (
        "SELECT rec_id, round(prediction, 6) AS prediction FROM scored")
    sql["model_round_trip"] = _with(trained, _descent(["train"] * 2, WIDTH, RATE)) + _exploded("state2", WIDTH)
    sql["factor_text_round_trip"] = f"SELECT side, line, count(*) AS times FROM ({sql['export_factors']}) GROUP BY ALL"
    sql["test_rmse_grid"] = sql["test_rmse"]
    batches = [f"positioned AS (SELECT *, row_number() OVER (ORDER BY {_order('rec_id')}) - 1 AS pos FROM train)"]
    for n in range(BATCHES):
        batches.append(f"batch{n} AS (SELECT * FROM positioned WHERE pos // "
                       f"((SELECT count(*) + {BATCHES - 1} FROM train) // {BATCHES}) = {n})")
    sql["minibatch_epoch"] = _with(trained, *batches, _descent([f"batch{n}" for n in range(BATCHES)], WIDTH, RATE)) + (
        _exploded(f"state{BATCHES}", WIDTH))
    trace = [f"SELECT CAST({n} AS INT) AS iter, round({_rmse('train', s)}, 6) AS train_rmse, "
             f"round({_rmse('test', s)}, 6) AS test_rmse" for n, s in enumerate(("state", "state1", "state2", "state3"))]
    sql["gd_trace"] = _with(trained, _descent(["train"] * 3, WIDTH, RATE)) + " UNION ALL ".join(trace)
    sql["run_configs"], sql["run_traces"], sql["epochs_to_target"] = _run_table()
    sql["train_resumed"] = _sequential(True, False, ADAPTIVE_RATE, epochs=2, trace=True)
    sql["gd_epoch_feature_sharded"] = sql["gd_epoch_wide"]
    sql["square_error_exact"] = sql["square_error_sum"]
    sql["init_factors_parity"] = _parity(WIDTH)
    sql["shuffle_records_bijective"] = _bijective("ratings", "rec_id", SEED)
    sql["dims"] = _with() + ("SELECT CAST(max(user_id) + 1 AS BIGINT) AS num_users, "
                             "CAST(max(item_id) + 1 AS BIGINT) AS num_items, count(*) AS num_records FROM ratings")
    last = "SELECT user_id, item_id, arg_max(rating, rec_id) AS rating, max(rec_id) AS rec_id FROM {} GROUP BY ALL"
    sql["dedupe_last"] = _with() + last.format("ratings")
    sql["user_profiles"] = _with() + f"SELECT user_id, item_id, rating FROM ({last.format('ratings')})"
    sql["user_profile_text"] = _with() + (
        "SELECT user_id, CAST(0 AS INT) AS part, user_id || ' ' || count(*) || ' ' || "
        "string_agg(item_id || ' ' || printf('%g', rating), ' ' ORDER BY item_id) AS text\n"
        f"FROM ({last.format('ratings')}) GROUP BY user_id")
    offsets = ("offsets AS (SELECT CAST(user_id AS INT) AS user_id, row_number() OVER o - 1 AS pos,\n"
               "  CAST(sum(cnt) OVER o - cnt AS BIGINT) AS base, cnt FROM (\n"
               "    SELECT id AS user_id, count(rec_id) AS cnt FROM (SELECT unnest(range((SELECT max(user_id) + 1\n"
               "      FROM {whole}))) AS id) LEFT JOIN {records} ON user_id = id GROUP BY id)\n"
               f"  WINDOW o AS (ORDER BY {_order('user_id')}))")
    sql["csr_offsets"] = _with(offsets.format(whole="ratings", records="ratings")) + "SELECT * FROM offsets"
    sql["shuffle_records"] = _with() + (
        f"SELECT rec_id, row_number() OVER (ORDER BY {_order('rec_id')}) - 1 AS pos FROM ratings")
    sql["shuffle_users"] = _with() + (
        f"SELECT CAST(user_id AS INT) AS user_id, row_number() OVER (ORDER BY {_order('user_id')}) - 1 AS pos\n"
        "FROM (SELECT unnest(range((SELECT max(user_id) + 1 FROM ratings))) AS user_id)")
    sql["batch_sizes"] = _with() + (
        f"SELECT pos // {BATCH_SIZE} AS batch, count(*) AS records, sum(rating) AS rating_sum FROM (\n"
        f"  SELECT rating, row_number() OVER (ORDER BY {_order('rec_id')}) - 1 AS pos FROM ratings) GROUP BY batch")
    sql["local_sgd_epoch"] = _parallel(
        f"SELECT *, pos // {RECORDS_PER_PART} AS part FROM (\n"
        f"  SELECT *, row_number() OVER (ORDER BY {_order('rec_id')}) - 1 AS pos FROM train)")
    sql["row_sgd_epoch"] = _parallel(
        f"SELECT base // {RECORDS_PER_PART} AS part, user_id, item_id, rating, pos * 2147483648 + item_id AS pos\n"
        "  FROM latest JOIN offsets USING (user_id)",
        f"latest AS ({last.format('train')})", offsets.format(whole="train", records="latest"))
    sql["sgd_epoch"] = _sequential(False, False, SGD_RATE)
    sql["adagrad_epoch"] = _sequential(True, False, ADAPTIVE_RATE)
    sql["minibatch_block_epoch"] = _sequential(False, False, SGD_RATE, batch=16)
    sql["train_trace"] = _sequential(True, False, ADAPTIVE_RATE, epochs=2, trace=True)
    sql["sgd_half_epoch"] = _sequential(False, True, SGD_RATE)
    sql["adagrad_half_epoch"] = _sequential(True, True, ADAPTIVE_RATE)
    return sql
