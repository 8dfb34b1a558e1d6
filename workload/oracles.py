"""DuckDB SQL that states, independently, what each query has to return."""

from __future__ import annotations

RATED = "documents JOIN labels USING (doc_id)"


def lowest_lots(source: str, id_col: str, k: int, columns: str) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY md5('42:' || {id_col}), {id_col} LIMIT {k}"


def stratified(source: str, id_col: str, label: str, size: str) -> str:
    """CTEs ending in ``ranked``: rows with their place in the stratum and its quota."""
    return f"""
      src AS (SELECT * FROM {source}),
      want AS (SELECT {size} AS k FROM src),
      n AS (SELECT {label} AS lab, count(*) AS c FROM src GROUP BY 1),
      split AS (SELECT lab, c, (k * c) // sum(c) OVER () AS base, (k * c) % sum(c) OVER () AS rest, k
                FROM n, want),
      quota AS (SELECT lab, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lab)
                  <= k - sum(base) OVER () THEN 1 ELSE 0 END AS q FROM split),
      ranked AS (SELECT src.*, q, row_number() OVER (PARTITION BY {label}
                  ORDER BY md5('42:' || {id_col}), {id_col}) AS place
                 FROM src JOIN quota ON lab = {label})"""


def edges(floor: float, labelled: bool = True) -> str:
    """CTE ``e``: pairs a < b with rounded cosine at or above the floor."""
    same = "x.label = y.label AND " if labelled else ""
    return f"""e AS MATERIALIZED (
      SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(
          x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings x JOIN embeddings y ON {same}x.vec_id < y.vec_id) WHERE sim >= {floor})"""


BOTH = "d AS MATERIALIZED (SELECT a, b, sim FROM e UNION ALL SELECT b, a, sim FROM e)"

PLACED = """p AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place
    FROM d)"""


def sequential_cap(cap: int) -> str:
    """CTEs from ``e`` to ``c``: nodes in id order drop what exceeds the cap."""
    return f"""{BOTH},
      adj AS MATERIALIZED (SELECT a, list(b ORDER BY sim DESC, b) AS ns,
                           row_number() OVER (ORDER BY a) AS turn FROM d GROUP BY a),
      run(turn, gone) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT adj.turn, list_concat(run.gone, list_transform(
            list_filter(adj.ns, lambda j: NOT list_contains(run.gone,
              least(adj.a, j) * 1000000 + greatest(adj.a, j)))[{cap + 1}:],
            lambda j: least(adj.a, j) * 1000000 + greatest(adj.a, j)))
        FROM run JOIN adj ON adj.turn = run.turn + 1),
      lost AS (SELECT unnest(gone) AS pair FROM (SELECT gone FROM run ORDER BY turn DESC LIMIT 1)),
      c AS MATERIALIZED (SELECT a, b, sim FROM e WHERE a * 1000000 + b NOT IN (SELECT pair FROM lost))"""


KEYS = """keys AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY m, v) - 1 AS ord FROM (
      SELECT v, min(struct_pack(i := i, s := s, far := far)) AS m FROM (
        SELECT vec_id AS v, vec_id AS i, 0 AS s, 0.0::DOUBLE AS far FROM embeddings
        UNION ALL SELECT b, a, 1, -sim FROM e UNION ALL SELECT a, b, 1, -sim FROM e)
      GROUP BY v))"""


def greedy(k: int) -> str:
    """CTEs from ``c`` and ``keys`` to ``g``: one pick at a time."""
    return f"""near AS (SELECT a AS v, b AS w FROM c UNION ALL SELECT b, a FROM c
        UNION ALL SELECT vec_id, vec_id FROM embeddings),
      nb AS MATERIALIZED (SELECT v, any_value(ord) AS ord, list(w) AS n
                          FROM near JOIN keys USING (v) GROUP BY v),
      g(step, v, gain, covered) AS (
        SELECT 0::BIGINT, -1::BIGINT, 0::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT step + 1, best.v, best.gain, list_concat(covered, best.n) FROM (
          SELECT step, covered, max_by(struct_pack(v := v, gain := gain, n := n),
                                       struct_pack(x := gain, y := -ord)) AS best
          FROM (SELECT g.step, g.covered, nb.v, nb.ord, nb.n,
                  len(list_filter(nb.n, lambda x: NOT list_contains(g.covered, x))) AS gain
                FROM g, nb WHERE g.step < {k} AND NOT list_contains(g.covered, nb.v))
          GROUP BY step, covered))"""


PICKS = "SELECT v AS id, gain::BIGINT AS gain, step::BIGINT AS pick_rank FROM g WHERE step > 0"


def bisection(k: int, coverage: float) -> str:
    """CTEs from ``e`` to ``run``: one row per pick, and one more per finished probe.

    A state is a probe with the picks it has made; it ends after ``k`` picks or when all
    is covered, and the next one starts in the half that the coverage asks for.
    """
    return f"""{BOTH},
      nb AS MATERIALIZED (
        SELECT vec_id AS v, list(struct_pack(w := b, s := sim)) FILTER (b IS NOT NULL) AS ns
        FROM embeddings LEFT JOIN d ON a = vec_id GROUP BY vec_id),
      size AS (SELECT count(*) AS n FROM embeddings),
      run(probe, low, high, theta, step, reached, covered, stop) AS (
        SELECT 1, 0::DOUBLE, 1000::DOUBLE, 500::DOUBLE, 0::BIGINT, 0::BIGINT, []::BIGINT[], false
        UNION ALL
        SELECT CASE WHEN full_ THEN probe + 1 ELSE probe END, low2, high2,
               CASE WHEN full_ THEN (low2 + high2) / 2 ELSE theta END,
               CASE WHEN full_ THEN 0 ELSE step + 1 END,
               CASE WHEN full_ THEN 0 ELSE reached + best.gain END,
               CASE WHEN full_ THEN [] ELSE list_concat(covered, best.n) END,
               full_ AND (reached / n = {coverage} OR high2 - low2 <= 1)
        FROM (
          SELECT *, CASE WHEN full_ AND reached / n >= {coverage} THEN theta ELSE low END AS low2,
                 CASE WHEN full_ AND reached / n < {coverage} THEN theta ELSE high END AS high2
          FROM (
            SELECT probe, low, high, theta, step, reached, covered, n, full_,
                   min_by(struct_pack(gain := gain, n := ws), struct_pack(g := -gain, o := ord, v := v)) AS best
            FROM (
              SELECT r.*, nb.v, list_append(list_transform(list_filter(coalesce(nb.ns, []),
                       lambda x: x.s >= r.theta / 1000), lambda x: x.w), nb.v) AS ws,
                     len(list_filter(ws, lambda x: NOT list_contains(r.covered, x))) AS gain,
                     list_min(list_append(list_transform(list_filter(coalesce(nb.ns, []),
                       lambda x: x.s >= r.theta / 1000 AND x.w < nb.v),
                       lambda x: struct_pack(i := x.w, m := 1, far := -x.s)),
                       struct_pack(i := nb.v, m := 0, far := 0.0::DOUBLE))) AS ord
              FROM (SELECT run.*, n, step = {k} OR reached = n AS full_ FROM run, size WHERE NOT stop) r
              LEFT JOIN nb ON NOT full_ AND NOT list_contains(r.covered, nb.v))
            GROUP BY ALL)))"""


def report(source: str) -> str:
    """Classification report of ``source(gold, pred)``."""
    return f"""
    WITH r AS ({source}),
      cls AS (SELECT DISTINCT gold::VARCHAR AS class FROM r UNION SELECT pred::VARCHAR FROM r),
      s AS (SELECT class,
              (SELECT count(*) FROM r WHERE gold::VARCHAR = class AND pred::VARCHAR = class) AS hits,
              (SELECT count(*) FROM r WHERE pred::VARCHAR = class) AS claimed,
              (SELECT count(*) FROM r WHERE gold::VARCHAR = class) AS support FROM cls),
      pr AS (SELECT class, support, hits, coalesce(hits / nullif(claimed, 0), 0)::DOUBLE AS precision,
               coalesce(hits / nullif(support, 0), 0)::DOUBLE AS recall FROM s),
      f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
      u AS (SELECT class, precision, recall, f1, support FROM f
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
          sum(hits) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      support::BIGINT AS support FROM u"""


WORDS = r"regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')"

TOKENS = rf"""w AS (SELECT conv_id * 1000 + turn AS sentence_id, {WORDS} AS ws FROM conversations),
      raw AS (SELECT sentence_id, unnest(range(len(ws)))::INTEGER AS token_pos,
                unnest(ws) AS sentence FROM w),
      tok AS (SELECT *, CASE WHEN regexp_matches(sentence, '^[A-Z]') THEN 'B-name'
                WHEN length(sentence) >= 7 THEN 'I-name' WHEN length(sentence) = 6 THEN 'I-term'
                ELSE 'O' END AS label,
              CASE WHEN regexp_matches(sentence, '^[A-Z]') AND length(sentence) >= 7 THEN 'B-name'
                WHEN length(sentence) >= 7 THEN 'I-name' WHEN length(sentence) >= 5 THEN 'I-term'
                ELSE 'O' END AS guess FROM raw)"""


def spans(tag: str, name: str) -> str:
    return f"""{name} AS (
      SELECT sentence_id, min(token_pos) AS "start", max(token_pos) AS "end", any_value(kind) AS "type"
      FROM (SELECT *, sum(CASE WHEN kind IS NOT NULL AND ({tag} LIKE 'B-%' OR kind IS DISTINCT FROM last)
              THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id ORDER BY token_pos) AS span
            FROM (SELECT *, lag(kind) OVER (PARTITION BY sentence_id ORDER BY token_pos) AS last
                  FROM (SELECT *, CASE WHEN {tag} LIKE 'B-%' OR {tag} LIKE 'I-%' THEN {tag}[3:] END AS kind
                        FROM tok)))
      WHERE kind IS NOT NULL GROUP BY sentence_id, span)"""


def set_scores(gold: str, guess: str) -> str:
    return f"""
      m AS (SELECT (SELECT count(*) FROM {gold}) AS gold, (SELECT count(*) FROM {guess}) AS predicted,
              (SELECT count(*) FROM (SELECT * FROM {gold} INTERSECT SELECT * FROM {guess})) AS matched),
      q AS (SELECT *, coalesce(matched / nullif(predicted, 0), 0)::DOUBLE AS precision,
              coalesce(matched / nullif(gold, 0), 0)::DOUBLE AS recall FROM m)
    SELECT gold, predicted, matched, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM q"""


def lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


RELATIONS = """rel AS (SELECT c_custkey, n_name AS name, 'customer in ' || n_name AS definition,
    c_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PAIR = "'Head Entity: ' || c_name || '; Tail Entity: ' || name"

EXAMPLES = """ex AS (SELECT o_custkey, o_orderkey, 'order of ' || o_orderpriority AS sentence,
    o_orderpriority AS tail, o_orderstatus AS name,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders)"""

ORACLES = {
    "random_sample": lowest_lots("documents", "doc_id", 100, "doc_id, lang, n_chars"),
    "random_sample_events": lowest_lots("events", "event_id", 5000, "event_id, user_id, event_type"),
    "stratified_sample": f"""WITH {stratified(RATED, 'doc_id', 'quality', '100')}
      SELECT doc_id, quality, n_chars FROM ranked WHERE place <= q""".replace(
        "SELECT 100 AS k FROM src", "SELECT 100 AS k"),
    "stratified_sample_events": f"""WITH {stratified('events', 'event_id', 'event_type', '1000')}
      SELECT event_id, event_type FROM ranked WHERE place <= q""".replace(
        "SELECT 1000 AS k FROM src", "SELECT 1000 AS k"),
    "group_sample": """SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (
      SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
      ORDER BY md5('42:' || conv_id), conv_id LIMIT 20)""",
    "score_sample": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200",
    "selection_replay": lowest_lots("documents", "doc_id", 150, "doc_id, source"),
    "holdout": f"""SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
      <= ceil(count(*) OVER () / 10) AS is_holdout FROM {RATED}""",
    "holdout_stratified": f"""WITH {stratified(RATED, 'doc_id', 'quality', 'ceil(count(*) / 10)::BIGINT')}
      SELECT doc_id, quality, place <= q AS is_holdout FROM ranked""",
    "shuffled_rows": """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1
      AS place FROM documents""",
    "label_distribution": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "label_counts": "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM embeddings",
    "last_group": "SELECT max(conv_id) AS last_id FROM conversations",
    "linearized_orders": """SELECT o_orderkey,
        'Head Entity : ' || c_name || ' , Tail Entity : ' || o_orderpriority || ' , Context : '
          || o_orderpriority || ' ' || c_mktsegment AS sentence,
        o_orderpriority || ' ' || c_mktsegment || ' <head> ' || c_name || ' <tail> '
          || o_orderpriority || ' <relation> ' || c_mktsegment AS tagged,
        'the relation between ' || c_name || ' and ' || o_orderpriority || ' is ' || c_mktsegment
          AS stated
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "marked_entities": f"""SELECT conv_id, turn, CASE WHEN ws[1] = '' THEN text ELSE replace(array_to_string(list_transform(
        string_split(text, ws[1]), lambda x: replace(x, ws[-1], '[' || ws[-1] || ' TAIL ENTITY]')),
        chr(1)), chr(1), '[' || ws[1] || ' HEAD ENTITY]') END AS marked
      FROM (SELECT *, {WORDS} AS ws FROM conversations)""",
    "vocabulary_index": """SELECT p_partkey, p_brand AS label,
        (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS label_idx FROM part""",
    "cleaned_text": "SELECT event_id, props FROM events WHERE props IS NOT NULL",
    "joined_splits": """SELECT doc_id, lang, source FROM documents WHERE lang = 'en'
      UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang <> 'en'""",
    "array_scores": """SELECT vec_id, (list_position(e, list_max(e)) - 1)::INTEGER AS best,
        round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS best_share,
        round(list_sum(list_transform(e, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid_sum,
        round(list_cosine_similarity(e, list_reverse(e)), 6) AS mirror
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "cosine_edges": f"WITH {edges(0.2, False)} SELECT a, b, sim FROM e",
    "cosine_edges_pivots": f"WITH {edges(0.2, False)} SELECT a, b, sim FROM e",
    "strongest_edges": f"""WITH {edges(0.1, False)} SELECT a, b, sim FROM e
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5""",
    "coverage_probes": f"""WITH RECURSIVE {edges(0.0)}, {bisection(12, 0.5)}
      SELECT probe::INTEGER AS probe, theta / 1000 AS threshold, reached / n AS coverage, step AS picks,
             reached AS covered
      FROM run, size WHERE step = 12 OR reached = n""",
    "label_edges": f"WITH {edges(0.1)} SELECT a, b, sim FROM e",
    "node_degrees": f"WITH {edges(0.1)}, {BOTH} SELECT a AS id, count(*) AS degree FROM d GROUP BY a",
    "degree_histogram": f"""WITH {edges(0.1)}, {BOTH},
      n AS (SELECT vec_id, count(a) AS degree FROM embeddings LEFT JOIN d ON a = vec_id GROUP BY vec_id)
      SELECT degree, count(*) AS nodes FROM n GROUP BY degree""",
    "top_neighbors": f"""WITH {edges(0.05)}, {BOTH}, {PLACED}
      SELECT a, b, sim, place::INTEGER AS place FROM p WHERE place <= 5""",
    "mutual_cap": f"""WITH {edges(0.05)}, {BOTH}, {PLACED}
      SELECT x.a, x.b, x.sim FROM p x JOIN p y ON x.a = y.b AND x.b = y.a
      WHERE x.a < x.b AND x.place <= 5 AND y.place <= 5""",
    "sequential_cap": f"WITH RECURSIVE {edges(0.05)}, {sequential_cap(5)} SELECT a, b, sim FROM c",
    "insertion_order": f"WITH {edges(0.1)}, {KEYS} SELECT v AS id, ord FROM keys",
    "max_cover": f"WITH RECURSIVE {edges(0.25)}, c AS (SELECT * FROM e), {KEYS}, {greedy(25)} {PICKS}",
    "max_cover_unlabelled": f"""WITH RECURSIVE {edges(0.25, False)}, c AS (SELECT * FROM e), {KEYS},
      {greedy(25)} {PICKS}""",
    # The search ends at these thresholds with these caps; the search path itself is
    # tested against a sequential model in tests/.
    "acs_sample": f"""WITH RECURSIVE {edges(0.125)}, {sequential_cap(45)}, {KEYS}, {greedy(50)}
      SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT v FROM g)""",
    "acs_picks": f"""WITH RECURSIVE {edges(0.3125, False)}, {sequential_cap(10)}, {KEYS}, {greedy(50)}
      {PICKS}""",
    "duplicate_cover": """SELECT min(doc_id) AS id, count(*) AS gain,
        row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS pick_rank
      FROM documents GROUP BY text ORDER BY pick_rank LIMIT 50""",
    "classification_report": report(
        f"SELECT quality AS gold, (n_chars > 500)::INTEGER AS pred FROM {RATED}"),
    "stored_report": report(f"SELECT toxic AS gold, (lang = 'de')::INTEGER AS pred FROM {RATED}"),
    "named_metrics": f"""WITH r AS (SELECT quality AS g, (n_chars > 500)::INTEGER AS p FROM {RATED})
      SELECT 'acc' AS metric, round(avg((g = p)::INTEGER), 6) AS value FROM r
      UNION ALL SELECT 'f1', round(2 * sum(g * p) / (sum(g) + sum(p)), 6) FROM r""",
    "bio_spans": f"""WITH {TOKENS}, {spans('label', 's')} SELECT sentence_id, "start", "end", "type" FROM s""",
    "entity_scores": f"""WITH {TOKENS}, {spans('label', 's')}, {spans('guess', 't')}, {set_scores('s', 't')}""",
    "tuple_scores": f"""WITH
      s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 <> 0),
      t AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50), {set_scores('s', 't')}""",
    "csv_source": f"SELECT md5(text) AS text_key, quality AS label FROM {RATED}",
    "relation_source": f"""SELECT 'Head Entity : ' || ws[1] || ' , Tail Entity : ' || ws[least(2, len(ws))] || ' ' || ws[least(3, len(ws))]
        || ' , Context : ' || array_to_string(ws, ' ') AS sentence, (conv_id % 64)::INTEGER AS label
      FROM (SELECT conv_id, {WORDS} AS ws FROM conversations) WHERE len(ws) > 0""",
    "bio_token_source": f"""WITH {TOKENS} SELECT dense_rank() OVER (ORDER BY sentence_id) - 1 AS sentence_id,
        token_pos, sentence, label FROM tok""",
    "bio_sentence_source": f"""WITH {TOKENS} SELECT row_number() OVER (ORDER BY sentence_id) - 1 AS row_id,
        array_to_string(ws, ' ') AS sentence FROM w""",
    "relation_catalogue": """SELECT 'P' || s_suppkey AS pid, n_name AS name,
        'supplies from ' || n_name AS definition, s_name AS example_head, n_name AS example_tail
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "batch_predictions": "SELECT doc_id, lang, length(text) % 2 AS predicted_label FROM documents",
    "pair_prompts": f"""WITH {RELATIONS} SELECT c_custkey, {lines(
        "'Generate 50 different Head Entity and Tail Entity with the given Relation.'",
        "'Relation: ' || name", "'Relation Definition: ' || definition", "'Relation: ' || name",
        PAIR, "'Head Entity:'")} AS prompt FROM rel""",
    "sentence_prompts": f"""WITH {RELATIONS} SELECT c_custkey, {lines(
        "'Generate a sentence with the given entities and relation.'", "'Relation: ' || name",
        PAIR, "'Sentence: ' || c_name || ' buys in ' || name", "'Relation: ' || name",
        "'Head Entity1: ' || c_mktsegment || '; Tail Entity2: ' || c_name",
        "'Sentence:'")} AS prompt FROM rel""",
    "few_shot_prompts": f"""WITH {EXAMPLES},
      t AS (SELECT *, replace(replace(sentence, 'order', '[order HEAD ENTITY]'), tail,
              '[' || tail || ' TAIL ENTITY]') || ' Relation: ' || name AS line FROM ex WHERE turn <= 8),
      firsts AS (SELECT o_custkey, string_agg(name, '; ' ORDER BY f) AS names FROM (
        SELECT o_custkey, name, min(o_orderkey) AS f FROM ex GROUP BY 1, 2) GROUP BY 1)
      SELECT o_custkey, {lines(
        "'Identify the relation between the head entity and the tail entity in the given sentence.'",
        "'Relation: ' || any_value(names)", "'#####'",
        "string_agg(line, chr(10) ORDER BY o_orderkey)")} AS prompt
      FROM t JOIN firsts USING (o_custkey) GROUP BY o_custkey""",
    "exemplars": f"""WITH {EXAMPLES} SELECT o_orderkey, {lines(
        "'Sentence: ' || sentence", "'Head Entity: order; Tail Entity: ' || tail",
        "'Relation: ' || name")} AS plain, {lines(
        "'Sentence: ' || sentence",
        "'the relation between order and ' || tail || ' is ' || name")} AS sentence,
        sentence || ' <head> order <tail> ' || tail || ' <relation> ' || name AS tagged FROM ex""",
    "entity_set_prompts": f"""SELECT l_orderkey, {lines(
        "'Generate text with all the given entities in the AI domain.'",
        "'Entities: ' || string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand)")} AS prompt
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "dispatcher_cases": f"""SELECT 'none' AS method, doc_id FROM documents
      UNION ALL SELECT 'whole', doc_id FROM documents
      UNION ALL SELECT 'random', doc_id FROM ({lowest_lots('documents', 'doc_id', 50, 'doc_id')})
      UNION ALL SELECT 'longest', doc_id FROM (
        SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)""",
    "acs_duplicates": """WITH v AS (SELECT vec_id, embedding FROM embeddings
        UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE vec_id % 3 = 0),
      g AS (SELECT min(vec_id) AS id, count(*) AS gain FROM v GROUP BY embedding
        UNION ALL SELECT vec_id + 2000000000, 1 FROM embeddings WHERE vec_id % 7 = 0)
      SELECT id, gain, row_number() OVER (ORDER BY gain DESC, id) AS pick_rank FROM g""",
    "train_and_dev_source": f"""WITH {TOKENS} SELECT
        row_number() OVER (ORDER BY sentence_id % 2, sentence_id) - 1 AS row_id,
        array_to_string(ws, ' ') AS sentence FROM w""",
    "sst2_source": """SELECT split, row_number() OVER (PARTITION BY split ORDER BY c_custkey) - 1 AS row_id,
        c_name || ' ' || c_mktsegment AS sentence, c_nationkey::INTEGER AS label
      FROM customer, (VALUES ('train'), ('test')) s(split)""",
    "limited_source": """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id,
        c_name || ' ' || c_mktsegment AS sentence, c_nationkey::INTEGER AS label
      FROM customer ORDER BY c_custkey LIMIT 100""",
    "stored_embeddings": """SELECT vec_id, len(embedding)::INTEGER AS dims,
        round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm FROM embeddings""",
    "entity_catalogue": """SELECT lower(r_name) AS entity, lower(r_name) || ': a nation of it' AS definition,
        'see below' AS examples, 15 AS wanted, 'AI' AS domain,
        row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INTEGER AS place, n_name AS example
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "relation_definitions": """SELECT p_partkey::VARCHAR AS name, 'made by ' || p_brand AS definition FROM part""",
    "stored_model": "SELECT doc_id, true AS known FROM documents WHERE text IS NOT NULL",
    "embedded_tfidf": r"""SELECT doc_id, 256 AS dims,
        CASE WHEN regexp_matches(text, '\w') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
    "train_and_report": f"""WITH {stratified(RATED, 'doc_id', 'quality', 'ceil(count(*) / 10)::BIGINT')},
      r AS (SELECT quality FROM ranked WHERE place <= q)
      SELECT quality::VARCHAR AS class, count(*) AS support FROM r GROUP BY quality
      UNION ALL SELECT name, (SELECT count(*) FROM r)
      FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) x(name)""",
    "method_sweep": f"""WITH n AS (SELECT count(*) - ceil(count(*) / 10)::BIGINT AS n FROM {RATED}),
      sizes AS (SELECT unnest([100, round_even((100 + n) / 2, 0), n]) AS k FROM n)
      SELECT 'documents' AS dataset, method, k::INTEGER AS k, 0 AS repeat, 42 AS seed
      FROM sizes, (VALUES ('random'), ('stratified')) m(method)""",
    "embedded_texts": """SELECT doc_id, length(text)::DOUBLE AS length,
        (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e_count FROM documents""",
}
