"""The corpora of ``linegrain.sources.corpora`` as DuckDB common table expressions."""


def up(x: str) -> str:
    """Upper case as in the JVM, where a sharp s becomes SS."""
    return f"replace(upper({x}), 'ẞ', 'SS')"


def toks(x: str) -> str:
    return rf"regexp_extract_all({up(x)}, '[^\s+-]+')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


QUANTITY = r"(?s)^(?:(.*) )?([0-9]+)$"


def surface(x: str) -> str:
    s = collapse(x)
    return (
        f"CASE WHEN regexp_matches({s}, '{QUANTITY}') "
        f"THEN regexp_extract({s}, '{QUANTITY}', 1) ELSE {s} END"
    )


def quantity(x: str) -> str:
    return f"TRY_CAST(regexp_extract({collapse(x)}, '{QUANTITY}', 2) AS BIGINT)"


def digits(x: str) -> str:
    s = collapse(x)
    found = f"coalesce(nullif(ltrim(regexp_extract({s}, '{QUANTITY}', 2), '0'), ''), '0')"
    return f"CASE WHEN regexp_matches({s}, '{QUANTITY}') THEN {found} END"


def clean(x: str) -> str:
    s = rf"regexp_replace({x}, '(?i)<br\s*/?>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?i)</?(?:sub|sup)[^>]*>', '', 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    for entity, char in [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
        ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
    ]:
        s = f"replace({s}, '{entity}', '{char}')"
    return collapse(f"replace({s}, ' ', ' ')")


def canonical(x: str) -> str:
    s = up(clean(x))
    s = rf"regexp_replace({s}, '\{{[^{{}}]*\}}', ' ', 'g')"
    s = f"regexp_replace({s}, '[•·|/…]', ' ', 'g')"
    for _ in range(2):  # neighbours share a separator, so a second pass is needed
        s = (
            rf"regexp_replace({s}, '(^|[^\p{{L}}\p{{N}}_])[0-9]+([^\p{{L}}\p{{N}}_]|$)',"
            r" '\1 \2', 'g')"
        )
    s = rf"regexp_replace({s}, '[^A-Z0-9*?+\-\[\] ]+', ' ', 'g')"
    return collapse(s)


SHAPE = r"^[\[\]]*\*?[A-Z0-9?]+[\[\]]*$"
STOPS = (
    "['VACAT','VACANT','DEEST','SUPRA','INFRA','MUTILA','LINE','STATEMENT','LOGOGRAM','NUMBER',"
    "'FRACTION','SIDE','NOTES','TOTAL','REST','VEST','BIS','TER','IMPRESSIONS']"
)


def plausible(t: str) -> str:
    core = rf"regexp_replace({t}[1], '^[\[\]]+|[\[\]]+$', '', 'g')"
    return f"""(len({t}) > 0 AND NOT list_has_any({t}, {STOPS})
      AND NOT (list_contains({t}, 'NO') AND list_contains({t}, 'OF') AND len({t}) >= 3)
      AND len(list_filter({t}, lambda t_: regexp_matches(t_, '{SHAPE}')))
          >= greatest(1, ceil(0.6::DOUBLE * len({t})))
      AND (len({t}) > 1 OR starts_with({core}, '*') OR regexp_matches({core}, '[0-9]')
           OR length({core}) >= 3))"""


EV = """ev AS (
  SELECT concat_ws('|', 'U' || user_id, strftime(ts, '%Y-%m-%d')) AS line_id,
         'U' || user_id AS artifact_id, 'S' || (user_id % 10) AS site,
         'R' || (user_id % 3) AS region,
         list(upper(event_type) ORDER BY ts, event_id) AS signs
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'))"""

RAW_DOCS = """raw_docs AS (
  SELECT doc_id, lang, source, line_no, trim(l) AS line FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  WHERE trim(l) <> '')"""

DOC = f"""{RAW_DOCS}, doc AS (
  SELECT * FROM (SELECT 'D' || doc_id || '|' || line_no AS line_id, 'D' || doc_id AS artifact_id,
    upper(source) AS site, upper(lang) AS region, {toks("line")} AS signs FROM raw_docs)
  WHERE len(signs) > 0)"""

OBS = f"""{RAW_DOCS}, raw_talk AS (
  SELECT conv_id, turn, role, line_no, trim(l) AS line FROM (
    SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations)
  WHERE trim(l) <> ''),
obs AS (
  SELECT 'D' || lpad(doc_id::VARCHAR, 12, '0') || ':' || lpad(line_no::VARCHAR, 9, '0')
           AS observation_id, 'doc:' || doc_id AS source_id, 'doc_text' AS source_kind,
         upper(source) AS artifact_id, line_no::VARCHAR AS line_id, line_no,
         {up(surface("line"))} AS sign_sequence, {quantity("line")} AS quantity,
         'doc:' || doc_id AS provenance, 'lang=' || lang AS notes FROM raw_docs
  UNION ALL
  SELECT 'E' || lpad(conv_id::VARCHAR, 12, '0') || ':' || lpad(turn::VARCHAR, 9, '0') || ':'
           || lpad(line_no::VARCHAR, 9, '0'), 'external:conv' || conv_id, 'external_csv',
         'SRC' || (conv_id % 20), turn || '.' || line_no, line_no,
         {up(surface("line"))}, {quantity("line")}, 'conv:' || conv_id, 'role=' || role
  FROM raw_talk)"""

VM_ROWS = rf"""vm_tokens AS (SELECT DISTINCT t FROM (SELECT unnest({toks("line")}) AS t FROM raw_docs)),
vm_rows AS (
  SELECT unnest(CASE right(t, 1)
    WHEN ',' THEN [{{'variant': t, 'canonical': s, 'status': 'exact', 'confidence': '1.0', 'notes': 'comma'}}]
    WHEN '.' THEN [{{'variant': t, 'canonical': s, 'status': 'high', 'confidence': '0.92', 'notes': 'stop'}}]
    WHEN '#' THEN [{{'variant': t, 'canonical': s, 'status': 'uncertain', 'confidence': '0.35', 'notes': 'hash'}}]
    WHEN '%' THEN [{{'variant': t, 'canonical': s, 'status': '', 'confidence': 'n/a', 'notes': ''}}]
    WHEN '$' THEN [{{'variant': t, 'canonical': '', 'status': 'canonical', 'confidence': '0.7', 'notes': 'dollar'}}]
    WHEN '*' THEN [{{'variant': t, 'canonical': s, 'status': 'exact', 'confidence': '0.9', 'notes': 'star'}},
                   {{'variant': t, 'canonical': s || '*', 'status': 'exact', 'confidence': '0.6', 'notes': 'starred'}}]
    WHEN '&' THEN [{{'variant': ' ' || t, 'canonical': s, 'status': 'Strict', 'confidence': '1.7', 'notes': 'amp'}}]
    END, recursive := true)
  FROM (SELECT t, regexp_extract(t, '^(\p{{L}}+)', 1) AS s FROM vm_tokens
        WHERE regexp_matches(t, '^\p{{L}}+[^\p{{L}}\p{{N}}]+$'))),
vm AS (
  SELECT {up("trim(variant)")} AS variant,
         coalesce(nullif({up("trim(canonical)")}, ''), {up("trim(variant)")}) AS canonical,
         coalesce(nullif(lower(trim(status)), ''), 'exact') AS status,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(confidence AS DOUBLE), 1.0::DOUBLE)))
           AS confidence, trim(notes) AS notes
  FROM vm_rows WHERE trim(variant) <> '')"""

CODED = f"""{EV}, coded AS (
  SELECT line_id, ['HT','KN','ARKH','PH','PK','ZA','PE','PS','SY','KH','KE','MI','MA','TH','KY',
      'MY','PYR','TY','QQ'][u % 19 + 1] || [' ', ' WC ', ' WA ', ' Z '][u % 4 + 1] || u
      AS artifact_id,
    list_transform(signs, lambda t: CASE t WHEN 'PURCHASE' THEN 'GRA' WHEN 'SIGNUP' THEN 'KU'
      WHEN 'ERROR' THEN 'RO' WHEN 'CLICK' THEN 'AB22' WHEN 'VIEW' THEN 'A12' END) AS signs,
    CASE WHEN d % 2 = 0 THEN d END AS quantity, 'user:' || u AS provenance,
    CASE WHEN u % 4 = 0 THEN 'html' ELSE 'external_csv' END AS source_kind
  FROM (SELECT *, substr(artifact_id, 2)::BIGINT AS u,
      substr(string_split(line_id, '|')[2], 9, 2)::BIGINT AS d FROM ev))"""


def object_class(a: str) -> str:
    return rf"""CASE WHEN contains(upper({a}), 'WC') THEN 'sealed_document_or_roundel'
      WHEN contains(upper({a}), 'WA') THEN 'nodule_or_sealing'
      WHEN contains(upper({a}), ' Z') THEN 'inscription_or_vessel'
      WHEN regexp_matches(upper({a}), '\b(HT|KH|ZA|ARKH|PH|KN)\b')
        THEN 'administrative_tablet_like' ELSE 'unclassified' END"""


def site(a: str) -> str:
    return f"coalesce(nullif(regexp_extract(trim({a}), '^([A-Z]+)', 1), ''), 'UNKNOWN')"


def region(s: str) -> str:
    return f"""CASE WHEN {s} IN ('HT','KN','ARKH','PH','PK') THEN 'crete_central'
      WHEN {s} IN ('ZA','PE','PS','SY') THEN 'crete_east' WHEN {s} = 'KH' THEN 'crete_west'
      WHEN {s} IN ('KE','MI','MA','TH','KY') THEN 'aegean_islands'
      WHEN {s} IN ('MY','PYR','TY') THEN 'mainland_or_external' ELSE 'unknown' END"""


FORMULA = """CASE WHEN list_has_any(signs, ['GRA','OLE','OLIV','VINA','VIN','FIC'])
      THEN 'commodity_accounting'
    WHEN contains(array_to_string(signs, ' '), 'KU RO') THEN 'total_formula_candidate'
    WHEN len(signs) = 4 AND signs[3] = 'AB22' THEN 'ab22_positional_formula'
    WHEN len(signs) <= 2 THEN 'short_mark_or_label'
    WHEN len(list_filter(signs, lambda t: regexp_matches(t, '^A[0-9]+$'))) > 0
      THEN 'a_series_sequence' ELSE 'unclassified' END"""

PURPOSE = """CASE WHEN formula_class IN ('commodity_accounting', 'total_formula_candidate',
      'ab22_positional_formula') THEN 'administrative'
    WHEN object_class = 'inscription_or_vessel' THEN 'ritual_or_display_possible'
    ELSE 'unknown' END"""

ATTRS = f"""{CODED}, at0 AS (SELECT *, {site("artifact_id")} AS site,
    {object_class("artifact_id")} AS object_class, {FORMULA} AS formula_class,
    CASE WHEN len(signs) <= 2 THEN 'short_1_2' WHEN len(signs) <= 4 THEN 'medium_3_4'
      ELSE 'long_5_plus' END AS length_bucket FROM coded),
  attrs AS (SELECT *, {region("site")} AS region FROM at0)"""

MODEL_KINDS = """mk(model, kind) AS (VALUES ('unigram','len'), ('unigram','uni'),
  ('first_bigram','len'), ('first_bigram','first'), ('first_bigram','bi'), ('bigram','len'),
  ('bigram','bi'), ('trigram','len'), ('trigram','tri'), ('position','len'), ('position','pos'))"""


def cells(name: str, source: str, by: list[str]) -> str:
    """Cells of ``source (by…, signs)`` as table ``name (by…, kind, ctx, tok, n)``."""
    b = "".join(f"{c}, " for c in by)
    i = "generate_series(1, len(signs))"
    return f"""{name} AS (SELECT {b}f.kind AS kind, f.ctx AS ctx, f.tok AS tok, count(*) AS n
    FROM (SELECT {b}unnest(list_concat(
      [{{'kind': 'len', 'ctx': '', 'tok': len(signs)::VARCHAR}},
       {{'kind': 'first', 'ctx': '', 'tok': signs[1]}}],
      list_transform({i}, lambda i: {{'kind': 'uni', 'ctx': '', 'tok': signs[i]}}),
      list_transform({i}, lambda i: {{'kind': 'bi', 'ctx': CASE WHEN i > 1 THEN signs[i - 1]
        ELSE '<BOS>' END, 'tok': signs[i]}}),
      list_transform({i}, lambda i: {{'kind': 'tri', 'ctx': CASE WHEN i > 2 THEN signs[i - 2]
        ELSE '<BOS>' END || ' ' || CASE WHEN i > 1 THEN signs[i - 1] ELSE '<BOS>' END,
        'tok': signs[i]}}),
      list_transform({i}, lambda i: {{'kind': 'pos', 'ctx': len(signs) || ':' || (i - 1),
        'tok': signs[i]}}))) AS f FROM {source}) GROUP BY {b}kind, ctx, tok)"""


def leave_out(name: str, own: str, by: list[str]) -> str:
    """Each group scored by a model of the rest of its split, cell by cell."""
    b = ", ".join(["split", *by])
    return f"""{name}_t AS (SELECT split, kind, ctx, tok, sum(n) AS total FROM {own} GROUP BY ALL),
  {name}_c AS (SELECT split, kind, ctx, sum(total) AS ctx_total FROM {name}_t GROUP BY ALL),
  {name}_w AS (SELECT split, count(*) FILTER (kind = 'uni') AS v, count(*) FILTER (kind = 'len')
    AS k, sum(total) FILTER (kind = 'uni') AS tokens, sum(total) FILTER (kind = 'len') AS lines
    FROM {name}_t GROUP BY split),
  {name}_g AS (SELECT {b}, count(*) FILTER (kind = 'uni' AND n = total) AS lv,
      count(*) FILTER (kind = 'len' AND n = total) AS lk,
      sum(n) FILTER (kind = 'uni') AS g_tokens, sum(n) FILTER (kind = 'len') AS g_lines
    FROM {own} JOIN {name}_t USING (split, kind, ctx, tok) GROUP BY {b}),
  {name}_x AS (SELECT {b}, kind, ctx, sum(n) AS n_ctx FROM {own} GROUP BY ALL),
  {name}_u AS (SELECT {b}, tok, total - n AS uni_rest FROM {own}
    JOIN {name}_t USING (split, kind, ctx, tok) WHERE kind = 'uni'),
  {name}_s AS (SELECT {b}, kind, g_lines, g_tokens, n, total - n AS rest,
      ctx_total - n_ctx AS rest_ctx, uni_rest, tokens - g_tokens AS rest_tokens,
      0.35::DOUBLE * (CASE WHEN kind = 'len' THEN k - lk ELSE greatest(1, v - lv) END + 1) AS w
    FROM {own} JOIN {name}_t USING (split, kind, ctx, tok) JOIN {name}_c USING (split, kind, ctx)
    JOIN {name}_x USING ({b}, kind, ctx) JOIN {name}_g USING ({b}) JOIN {name}_w USING (split)
    JOIN {name}_u USING ({b}, tok)  WHERE g_lines < lines AND kind NOT IN ('len')
    UNION ALL
    SELECT {b}, kind, g_lines, g_tokens, n, total - n, ctx_total - n_ctx, 0, tokens - g_tokens,
      0.35::DOUBLE * (k - lk + 1)
    FROM {own} JOIN {name}_t USING (split, kind, ctx, tok) JOIN {name}_c USING (split, kind, ctx)
    JOIN {name}_x USING ({b}, kind, ctx) JOIN {name}_g USING ({b}) JOIN {name}_w USING (split)
    WHERE g_lines < lines AND kind = 'len'),
  {name} AS (SELECT {b}, model, sum(n * CASE WHEN kind = 'pos' AND rest_ctx = 0
      THEN ln((uni_rest + 0.35::DOUBLE) / (rest_tokens + w))
      ELSE ln((rest + 0.35::DOUBLE) / (rest_ctx + w)) END) AS ll,
      first(g_lines) AS lines, first(g_tokens) AS tokens
    FROM {name}_s JOIN mk USING (kind) GROUP BY {b}, model)"""


def transfer(name: str, train: str, test: str, by: list[str]) -> str:
    """Test cells scored under the counts of train cells."""
    b = "".join(f"{c}, " for c in by)
    return f"""{name}_t AS (SELECT kind, ctx, tok, sum(n) AS total FROM {train} GROUP BY ALL),
  {name}_c AS (SELECT kind, ctx, sum(total) AS ctx_total FROM {name}_t GROUP BY ALL),
  {name}_w AS (SELECT count(*) FILTER (kind = 'uni') AS v, count(*) FILTER (kind = 'len') AS k,
    sum(total) FILTER (kind = 'uni') AS tokens FROM {name}_t),
  {name}_s AS (SELECT {b}x.kind, x.n, coalesce(t.total, 0) AS total,
      coalesce(c.ctx_total, 0) AS ctx_total, coalesce(u.total, 0) AS uni_total, w.tokens,
      0.35::DOUBLE * (CASE WHEN x.kind = 'len' THEN w.k ELSE greatest(1, w.v) END + 1) AS w
    FROM {test} x LEFT JOIN {name}_t t ON t.kind = x.kind AND t.ctx = x.ctx AND t.tok = x.tok
    LEFT JOIN {name}_c c ON c.kind = x.kind AND c.ctx = x.ctx
    LEFT JOIN {name}_t u ON u.kind = 'uni' AND u.tok = x.tok CROSS JOIN {name}_w w),
  {name} AS (SELECT {b}model, sum(n * CASE WHEN kind = 'pos' AND ctx_total = 0
      THEN ln((uni_total + 0.35::DOUBLE) / (tokens + w))
      ELSE ln((total + 0.35::DOUBLE) / (ctx_total + w)) END) AS ll FROM {name}_s
    JOIN mk USING (kind) GROUP BY {b}model),
  {name}_z AS (SELECT {b}sum(n) FILTER (kind = 'len') AS lines,
    sum(n) FILTER (kind = 'uni') AS tokens FROM {test} GROUP BY {b[:-2] if by else "ALL"})"""
