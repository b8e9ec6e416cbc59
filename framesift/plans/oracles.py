"""The registered queries as SQL for a second engine, over the same whole tables."""

from __future__ import annotations

T = 0.35
K = 10
OUT = "/out"

EXT = "['.png', '.JPG', '.jpeg', '.gif', '.txt', '.PNG'][doc_id % 6 + 1]"
FILES = f"""files AS (
  SELECT doc_id, 'IMG_' || doc_id || {EXT} AS filename,
         '/set/' || source || '/IMG_' || doc_id || {EXT} AS path
  FROM documents)"""


def sizes(source: str, key: str) -> str:
    return f"""sizes AS (
  SELECT {key}, 100 + ({key} * 37) % 5000 AS width, 100 + ({key} * 91) % 4000 AS height
  FROM {source})"""


def hex_bits(cells: str, n: int) -> str:
    """Hex text of the bits ``cell > mean`` of a list expression."""
    bit = f"CASE WHEN {cells}[4 * q + {{}}] > list_avg({cells}) THEN {{}} ELSE 0 END"
    digit = " + ".join(bit.format(i + 1, 8 >> i) for i in range(4))
    return (
        f"array_to_string(list_transform(range(0, {n // 4}), "
        f"lambda q: substr('0123456789abcdef', 1 + {digit}, 1)), '')"
    )


COARSE = f"""grids AS (
  SELECT vec_id, list_transform(range(0, 8), lambda c: list_avg(list_transform(
           list_filter(range(0, 64), lambda m: ((m // 8) // 4) * 4 + (m % 8) // 2 = c),
           lambda m: embedding[m + 1]::DOUBLE))) AS cells
  FROM embeddings),
hashes AS (SELECT vec_id, {hex_bits('cells', 8)} AS hash FROM grids)"""

DUPLICATES = """dups AS (
  SELECT vec_id, hash, kept FROM (
    SELECT vec_id, hash, min(vec_id) OVER (PARTITION BY hash) AS kept FROM hashes)
  WHERE vec_id <> kept)"""


def pairs(source: str) -> str:
    """Pairs above the threshold, then the greedy walk over them in (later, earlier) order."""
    return f"""pts AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM {source}),
sims AS MATERIALIZED (
  SELECT a.vec_id AS earlier, b.vec_id AS later, list_cosine_similarity(a.v, b.v) AS similarity
  FROM pts a JOIN pts b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) > {T}),
edges AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY later, earlier) AS n, * FROM sims),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS used, FALSE AS took
  UNION ALL
  SELECT e.n,
    CASE WHEN list_contains(w.used, e.later) OR list_contains(w.used, e.earlier) THEN w.used
         ELSE list_concat(w.used, [e.later, e.earlier]) END,
    NOT (list_contains(w.used, e.later) OR list_contains(w.used, e.earlier))
  FROM walk w JOIN edges e ON e.n = w.n + 1),
matched AS MATERIALIZED (
  SELECT e.later AS moved, e.earlier AS kept, e.similarity
  FROM edges e JOIN walk w ON w.n = e.n WHERE w.took)"""


TWO_STEP = f"""{COARSE},
{DUPLICATES},
rest AS (SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM dups)),
{pairs('rest')},
routes AS (
  SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM dups) THEN 'duplicate_images'
                      WHEN vec_id IN (SELECT moved FROM matched) THEN 'similar_images'
                      ELSE 'keep' END AS route
  FROM embeddings)"""

FACES = """faces AS (
  SELECT o_orderkey AS image_id, coalesce(n, 0) AS n_faces
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey)"""
FACE_ROUTE = "CASE WHEN n_faces = 0 THEN 'no_faces' WHEN n_faces > 1 THEN 'multiple_faces' ELSE 'keep' END"
FACE_STATS = """SELECT count(*) AS total_images, count(*) FILTER (n_faces = 0) AS no_faces,
  count(*) FILTER (n_faces > 1) AS multiple_faces, count(*) FILTER (n_faces = 1) AS single_face FROM faces"""

FLUX = """array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'),
  lambda w: regexp_full_match(w, '\\pL+')), lambda w: upper(w[1])), '') || '_' || substr(sha1({0}), 1, 5)"""


def means(rows: str) -> str:
    """Mean vector per cluster of a relation (cluster, v)."""
    return f"""SELECT cluster, list(m ORDER BY i) AS center FROM (
    SELECT cluster, i, avg(x) AS m FROM (
      SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows})
    GROUP BY cluster, i) GROUP BY cluster"""


FIXED = f"""pts AS (SELECT vec_id, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings),
centers AS MATERIALIZED ({means('pts')}),
own AS (SELECT vec_id, p.cluster, list_distance(v, center) AS d FROM pts p JOIN centers c ON p.cluster = c.cluster),
away AS (SELECT vec_id, p.cluster, coalesce(min(list_distance(v, center)), 0) AS d
         FROM pts p LEFT JOIN centers c ON p.cluster <> c.cluster GROUP BY vec_id, p.cluster)"""
PICK_FAR = """picked AS (SELECT vec_id, cluster, d FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d DESC, vec_id) AS r FROM away) WHERE r = 1)"""


def nearest(points: str, centers: str) -> str:
    return f"""SELECT vec_id, v, cluster, d FROM (
    SELECT p.vec_id, p.v, c.cluster, list_distance(p.v, c.center) AS d,
           row_number() OVER (PARTITION BY p.vec_id ORDER BY list_distance(p.v, c.center), c.cluster) AS r
    FROM {points} p CROSS JOIN {centers} c) WHERE r = 1"""


STEPS = 60  # beyond the point from which steps change nothing


def kmeans(source: str, k: int, steps: int) -> str:
    """CTEs pts, c0..cn, final: Lloyd steps from the vectors of the k lowest ids."""
    out = [
        f"pts AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM {source})",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v AS center
  FROM (SELECT * FROM pts ORDER BY vec_id LIMIT {k}))""",
    ]
    for i in range(steps):
        out.append(f"a{i} AS MATERIALIZED ({nearest('pts', f'c{i}')})")
        out.append(
            f"""m{i} AS MATERIALIZED ({means(f'a{i}')}),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.center, o.center) AS center
  FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.cluster)"""
        )
    out.append(f"final AS MATERIALIZED ({nearest('pts', f'c{steps}')})")
    return ",\n".join(out)


SQUARINGS = 24


def axis(t: int, matrix: str) -> str:
    """CTE v{t}: first axis of a symmetric relation (i, j, x), by squaring it until one axis is left.

    A column of the outcome is the axis up to its length; the column of the largest loading gives it a positive sign.
    """
    out = [f"p{t}_0 AS MATERIALIZED (SELECT i, j, x / (SELECT sqrt(sum(x * x)) FROM {matrix}) AS x FROM {matrix})"]
    for n in range(SQUARINGS):
        p = f"p{t}_{n}"
        out.append(
            f"""p{t}_{n + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) / (SELECT sum(x * x) FROM {p}) AS x
  FROM {p} a JOIN {p} b ON a.j = b.i GROUP BY a.i, b.j)"""
        )
    p = f"p{t}_{SQUARINGS}"
    out.append(
        f"""v{t} AS MATERIALIZED (SELECT i, x / (SELECT sqrt(max(x)) FROM {p} WHERE i = j) AS x
  FROM {p} WHERE j = (SELECT arg_max(i, x) FROM {p} WHERE i = j))"""
    )
    return ",\n".join(out)


AXES = f"""cells AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pts),
mids AS (SELECT i, avg(x) AS m FROM cells GROUP BY i),
flat AS MATERIALIZED (SELECT vec_id, c.i, x - m AS x FROM cells c JOIN mids m ON m.i = c.i),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM flat a JOIN flat b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
{axis(1, 'cov')},
less AS MATERIALIZED (
  SELECT c.i, c.j, c.x - a.x * b.x * (SELECT sum(l.x * c.x * r.x) FROM cov c JOIN v1 l ON l.i = c.i JOIN v1 r ON r.i = c.j) AS x
  FROM cov c JOIN v1 a ON a.i = c.i JOIN v1 b ON b.i = c.j),
{axis(2, 'less')},
spots AS (SELECT vec_id, round(sum(f.x * v1.x), 4) AS x, round(sum(f.x * v2.x), 4) AS y
  FROM flat f JOIN v1 ON v1.i = f.i JOIN v2 ON v2.i = f.i GROUP BY vec_id)"""

VALID = "valid AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 7 <> 0)"
CAPTIONS = """captions AS (
  SELECT conv_id, 'IMG_' || conv_id || '.png' AS filename, turn AS pos, text AS caption
  FROM conversations WHERE role = 'assistant')"""
IDENTIFIERS = """ids AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part
  UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)"""
TXT = "regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1') || '.txt'"
VEC_NAME = "'IMG_' || vec_id || '.png'"

ORACLES: dict[str, str] = {
    "file_meta": f"""WITH {FILES} SELECT path, filename,
  regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1') AS stem, regexp_extract(filename, '\\.[^.]+$') AS ext FROM files""",
    "filter_image_ext": f"""WITH {FILES} SELECT doc_id, filename FROM files
  WHERE regexp_matches(lower(filename), '\\.(png|jpg|jpeg)$')""",
    "average_hash_grid": f"""WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS cells FROM embeddings)
  SELECT vec_id, {hex_bits('cells', 64)} AS hash FROM g""",
    "resize_plan": f"""WITH {sizes('documents', 'doc_id')},
  r AS (SELECT *, least(2048.0::DOUBLE / width, 2048.0::DOUBLE / height) AS ratio,
               width > 2048 OR height > 2048 AS over FROM sizes)
  SELECT doc_id, width::INT AS width, height::INT AS height,
    CASE WHEN over THEN floor(width * ratio) ELSE width END::INT AS new_width,
    CASE WHEN over THEN floor(height * ratio) ELSE height END::INT AS new_height, over AS resized FROM r""",
    "thumbnail_plan": f"""WITH {sizes('documents', 'doc_id')},
  r AS (SELECT doc_id, width::DOUBLE AS w, height::DOUBLE AS h FROM sizes)
  SELECT doc_id, CASE WHEN w / h > 1 THEN 256 ELSE round_even(w / h * 256, 0) END::INT AS thumb_width,
    CASE WHEN w / h > 1 THEN round_even(h / w * 256, 0) ELSE 256 END::INT AS thumb_height FROM r""",
    "fluxkey": f"""WITH {IDENTIFIERS} SELECT kind, id, {FLUX.format('name')} AS hashed, trim(name) AS plain FROM ids""",
    "export_name": f"""WITH {IDENTIFIERS}, k AS (SELECT kind, id, {FLUX.format('name')} AS h, trim(name) AS p FROM ids)
  SELECT kind, id, CASE WHEN contains(h, '_') THEN h || '_captions.zip' ELSE 'captions.zip' END AS hashed_export,
    CASE WHEN contains(p, '_') THEN p || '_captions.zip' ELSE 'captions.zip' END AS plain_export FROM k""",
    "caption_prefix": f"""WITH {CAPTIONS}, n AS (SELECT *, 'Photo Set ' || (conv_id % 5) AS name FROM captions)
  SELECT conv_id, pos, {FLUX.format('name')} || ', ' || caption AS caption FROM n""",
    "request_key": """WITH p AS (
    SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10000 AS chunk FROM events),
  d AS (SELECT user_id, chunk, count(*) AS n, md5(string_agg(event_id || ':' || epoch_us(ts), '|' ORDER BY ts, event_id)) AS digest
        FROM p GROUP BY 1, 2)
  SELECT user_id AS request, sum(n)::BIGINT AS n_files,
    md5(string_agg(digest, '|' ORDER BY chunk) || '|describe|user ' || user_id || '|'
      || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END || '|model-a') AS request_key
  FROM d GROUP BY user_id""",
    "hash_duplicates": f"WITH {COARSE}, {DUPLICATES} SELECT vec_id, hash, kept FROM dups",
    "hash_stats": f"WITH {COARSE} SELECT count(*) AS total_images, count(*) - count(DISTINCT hash) AS duplicates_found FROM hashes",
    "remaining_after_hash": f"""WITH {COARSE}, {DUPLICATES}
  SELECT vec_id, hash FROM hashes WHERE vec_id NOT IN (SELECT vec_id FROM dups)""",
    "cosine_pairs": f"""WITH g AS (SELECT min(vec_id) AS id, count(*) AS c, embedding::DOUBLE[] AS v
    FROM embeddings GROUP BY embedding)
  SELECT a.id AS earlier, b.id AS later, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, a.c * b.c AS n_pairs
  FROM g a JOIN g b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {T}
  UNION ALL SELECT id, id, 1.0, (c * (c - 1) // 2)::BIGINT FROM g WHERE c > 1""",
    "greedy_similar_pairs": f"""WITH RECURSIVE {pairs('embeddings')}
  SELECT moved, kept, round(similarity, 6) AS similarity FROM matched""",
    "pair_report": f"""WITH RECURSIVE {pairs('embeddings')}, {sizes('embeddings', 'vec_id')},
  n AS (SELECT row_number() OVER (ORDER BY moved) AS pair_no, * FROM matched)
  SELECT pair_no, moved, kept, round(similarity, 6) AS similarity,
    'Similarity: ' || printf('%.2f', similarity) AS text, 'similar_' || pair_no || '.jpg' AS picture,
    300 AS height, floor(a.width * 300 / a.height)::INT AS moved_width, floor(b.width * 300 / b.height)::INT AS kept_width,
    (floor(a.width * 300 / a.height) + floor(b.width * 300 / b.height))::INT AS total_width
  FROM n JOIN sizes a ON a.vec_id = moved JOIN sizes b ON b.vec_id = kept""",
    "similarity_stats": f"""WITH RECURSIVE {TWO_STEP} SELECT count(*) AS total_images,
    count(*) FILTER (route = 'duplicate_images') AS duplicates_found,
    count(*) FILTER (route = 'similar_images') AS similar_pairs FROM routes""",
    "stage_similarity": f"WITH RECURSIVE {TWO_STEP} SELECT vec_id, route FROM routes",
    "route_manifest": f"WITH RECURSIVE {TWO_STEP} SELECT vec_id, route FROM routes",
    "moved_images": f"WITH RECURSIVE {TWO_STEP} SELECT vec_id FROM routes WHERE route <> 'keep'",
    "result_labels": f"""WITH RECURSIVE {TWO_STEP}, {FACES}
  SELECT route, 'Duplicate: ' || {VEC_NAME} AS label FROM routes WHERE route = 'duplicate_images'
  UNION ALL SELECT 'similar_images', 'Similar pair: similar_' || row_number() OVER (ORDER BY moved) || '.jpg' FROM matched
  UNION ALL SELECT {FACE_ROUTE}, CASE WHEN n_faces = 0 THEN 'No face: ' ELSE 'Multiple faces: ' END
    || 'IMG_' || image_id || '.png' FROM faces WHERE n_faces <> 1""",
    "stage_status": f"""WITH RECURSIVE {TWO_STEP}, {FACES}, fs AS ({FACE_STATS}),
  s AS (SELECT count(*) FILTER (route = 'duplicate_images') AS d, count(*) FILTER (route = 'similar_images') AS p FROM routes)
  SELECT 'similarity' AS stage, CASE WHEN d > 0 THEN 'Found and moved ' || d || ' duplicate images to {OUT}/duplicate_images'
      ELSE 'No duplicate images found with perceptual hash' END || chr(10) ||
    CASE WHEN p > 0 THEN 'Found ' || p || ' similar image pairs with VGG16 (threshold: {T})' || chr(10)
      || 'One image from each pair moved to {OUT}/similar_images' || chr(10)
      || 'Comparison images created in {OUT}/similar_images/similar_pairs'
      ELSE 'No similar images found with VGG16 (threshold: {T})' END AS status FROM s
  UNION ALL SELECT 'faces', 'Processed ' || total_images || ' images:' || chr(10)
    || '• ' || no_faces || ' images with no faces moved to {OUT}/no_faces' || chr(10)
    || '• ' || multiple_faces || ' images with multiple faces moved to {OUT}/multiple_faces' || chr(10)
    || '• ' || single_face || ' images with single faces remained in the input directory' FROM fs
  UNION ALL SELECT 'refinement', 'Successfully clustered images into ' || count(DISTINCT label) || ' groups.' || chr(10)
    || 'Selected ' || count(DISTINCT label) || ' representative images using ''diversity'' method.' || chr(10)
    || 'Images saved to: {OUT}/diversity_cluster' || chr(10)
    || 'Files are named with their cluster number for reference.' || chr(10)
    || 'Interactive visualization available at: {OUT}/visualization/cluster_visualization.html' FROM embeddings""",
    "faces_per_image": f"WITH {FACES} SELECT image_id, n_faces FROM faces",
    "face_route": f"WITH {FACES} SELECT image_id, n_faces, {FACE_ROUTE} AS route FROM faces",
    "face_stats": f"WITH {FACES} {FACE_STATS}",
    "valid_embeddings": f"WITH {VALID} SELECT vec_id FROM valid",
    "distance_to_center": f"WITH {FIXED} SELECT vec_id, cluster, round(d, 6) AS distance FROM own",
    "min_other_center_distance": f"WITH {FIXED} SELECT vec_id, cluster, round(d, 6) AS distance FROM away",
    "select_consistency": f"""WITH {FIXED} SELECT vec_id, cluster, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) AS r FROM own) WHERE r = 1""",
    "select_diversity": f"WITH {FIXED}, {PICK_FAR} SELECT vec_id, cluster, round(d, 6) AS distance FROM picked",
    "cluster_dest_name": f"""WITH {FIXED}, {PICK_FAR} SELECT vec_id,
    'diversity_cluster/IMG_' || vec_id || '_cluster' || cluster || '.png' AS dest_name,
    'Cluster ' || cluster || ': ' || {VEC_NAME} AS label FROM picked""",
    "cluster_stats": """SELECT count(DISTINCT label) AS groups_formed, count(*) AS images_clustered,
    count(DISTINCT label) AS images_selected FROM embeddings""",
    "lloyd_step": f"""WITH {kmeans('embeddings', K, 1)}
  SELECT cluster, n, i - 1 AS dim, round(x, 6) AS value FROM (
    SELECT m.cluster, n, unnest(center) AS x, generate_subscripts(center, 1) AS i
    FROM m0 m JOIN (SELECT cluster, count(*) AS n FROM a0 GROUP BY 1) s ON s.cluster = m.cluster)""",
    "kmeans_assign": f"""WITH {kmeans('embeddings', K, STEPS)} SELECT vec_id, cluster, round(d, 6) AS distance FROM final""",
    "stage_refine": f"""WITH {VALID}, {kmeans('valid', K, STEPS)},
  away AS (SELECT p.vec_id, p.cluster, min(list_distance(p.v, c.center)) AS d
           FROM final p JOIN c{STEPS} c ON c.cluster <> p.cluster GROUP BY 1, 2), {PICK_FAR}
  SELECT vec_id, cluster, round(d, 6) AS distance,
    'diversity_cluster/IMG_' || vec_id || '_cluster' || cluster || '.png' AS dest_name FROM picked""",
    "cluster_plot_data": f"""WITH {VALID}, {kmeans('valid', K, STEPS)},
  away AS (SELECT p.vec_id, p.cluster, min(list_distance(p.v, c.center)) AS d
           FROM final p JOIN c{STEPS} c ON c.cluster <> p.cluster GROUP BY 1, 2), {PICK_FAR},
  {AXES}
  SELECT vec_id, CASE WHEN x = 0 THEN 0 ELSE x END AS x, CASE WHEN y = 0 THEN 0 ELSE y END AS y,
    cluster, vec_id IN (SELECT vec_id FROM picked) AS is_selected FROM final JOIN spots USING (vec_id)""",
    "plot_tiles": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS cluster, vec_id % 10 = 0 AS sel FROM embeddings),
  e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p),
  s AS (SELECT vec_id, cluster, sel, zoom,
      least(floor((x - lx) / (hx - lx) * 64), 63)::BIGINT // (8 // (2 ** zoom)::INT) AS gx,
      least(floor((y - ly) / (hy - ly) * 64), 63)::BIGINT // (8 // (2 ** zoom)::INT) AS gy
    FROM p, e, range(0, 4) z(zoom)),
  k AS (SELECT zoom, gx, gy, cluster, count(*) AS n, count(*) FILTER (sel) AS m, min(vec_id) AS f FROM s GROUP BY ALL),
  c AS (SELECT zoom, gx, gy, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m, min(f) AS f,
      (list(cluster ORDER BY n DESC, cluster))[1] AS cluster FROM k GROUP BY ALL)
  SELECT zoom::INT AS zoom, (gx // 8)::INT AS tx, (gy // 8)::INT AS ty, sum(n)::BIGINT AS n_points, sum(m)::BIGINT AS n_selected,
    count(*) AS n_cells, '[' || string_agg('{"cx":' || gx % 8 || ',"cy":' || gy % 8 || ',"n":' || n || ',"n_selected":' || m
      || ',"cluster":' || cluster || ',"first_id":' || f || '}', ',' ORDER BY gx, gy) || ']' AS cells
  FROM c GROUP BY 1, 2, 3""",
    "prompt_cross": f"WITH {CAPTIONS} SELECT conv_id, pos, r_name AS prompt FROM captions CROSS JOIN region",
    "prompt_answers": f"""WITH {CAPTIONS} SELECT conv_id, pos, r_regionkey AS prompt_no, r_name AS prompt,
    r_name || ': ' || caption AS answer FROM captions CROSS JOIN region""",
    "caption_export_files": f"""WITH {CAPTIONS},
  r AS (SELECT *, 'Photo Set ' || (conv_id % 5) AS name, conv_id % 2 = 0 AS hashed FROM captions),
  k AS (SELECT *, CASE WHEN hashed THEN {FLUX.format('name')} ELSE trim(name) END AS label FROM r)
  SELECT conv_id AS request, CASE WHEN contains(label, '_') THEN label || '_captions' ELSE 'captions' END AS folder,
    {TXT} AS txt_name, arg_max(caption, pos) AS content FROM k GROUP BY 1, 2, 3""",
    "unique_copy_names": """WITH d AS (SELECT doc_id, '/set/' || doc_id || '.png' AS path, 'out.d/IMG_' || doc_id % 300 AS base FROM documents)
  SELECT doc_id, path, base || CASE WHEN path = min(path) OVER (PARTITION BY base) THEN '' ELSE '-' || substr(md5(path), 1, 12) END
    || '.png' AS dest_name FROM d""",
    "cache_hits": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "cache_misses": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "caption_list": f"""WITH {CAPTIONS} SELECT conv_id, pos, caption FROM captions""",
    "caption_at": f"""WITH {CAPTIONS}, r AS (
    SELECT conv_id, caption, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM captions)
  SELECT q.conv_id, coalesce(r.caption, '') AS caption
  FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN r ON r.conv_id = q.conv_id AND n = 3""",
    "caption_export": f"""WITH {CAPTIONS} SELECT {TXT} AS txt_name, arg_max(caption, pos) AS content
  FROM captions GROUP BY 1""",
    "stage_caption": f"""WITH {CAPTIONS},
  r AS (SELECT *, 'Photo Set ' || (conv_id % 5) AS name, conv_id % 2 = 0 AS hashed FROM captions),
  k AS (SELECT conv_id, md5(md5(string_agg('/set/' || filename || ':' || (conv_id * 60000000),
      '|' ORDER BY pos)) || '|describe|' || any_value(name) || '|'
      || CASE WHEN any_value(hashed) THEN 'True' ELSE 'False' END || '|model-a') AS request_key FROM r GROUP BY 1)
  SELECT conv_id AS request, request_key, call, {TXT} AS txt_name,
    arg_max(CASE WHEN hashed THEN {FLUX.format('name')} ELSE trim(name) END || ', ' || caption, pos) AS content
  FROM r JOIN k USING (conv_id), (VALUES (1), (2)) calls(call) GROUP BY 1, 2, 3, 4""",
}

# The last stage clusters what the first two leave over; its points come from `single`.
_SINGLE = f"""{TWO_STEP},
single AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IN (SELECT vec_id FROM routes WHERE route = 'keep')
    AND vec_id IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1))"""
_STEPS = kmeans("single", 5, STEPS).replace("pts AS", "points AS", 1).replace("FROM pts", "FROM points")
ORACLES["full_flow"] = f"""WITH RECURSIVE {_SINGLE}, {_STEPS},
  best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id) AS r FROM final)
  SELECT vec_id, cluster, 'IMG_' || vec_id || '.txt' AS txt_name, {FLUX.format("'Photo Set'")} || ', ' || text AS content
  FROM best JOIN documents ON doc_id = vec_id WHERE r = 1"""
