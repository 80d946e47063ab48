"""The registered queries as DuckDB SQL over the same tables.

Written independently of the Spark code: sequential rules are recursive
queries, aggregates that Spark combines in parts are windows here.
"""

from __future__ import annotations

# A catalogue over `documents`; {gate} is a size from which files have no digests.
_MEDIA = r"""
media AS (
  SELECT doc_id AS pos,
         CAST(doc_id AS VARCHAR) AS id,
         '/media/' || source || '/' || doc_id || '/' || file_name AS path,
         file_name, file_size, extension,
         CASE WHEN file_size < {gate} THEN md5(text) END AS md5_hash,
         CASE WHEN file_size < {gate} THEN sha256(text) END AS sha256_hash,
         xor(CAST('0x' || substr(md5(CAST(doc_id // 4 AS VARCHAR)), 1, 16) AS UBIGINT),
             CAST([0, 255, 65535, 1][doc_id % 4 + 1] AS UBIGINT)) AS phash,
         CASE WHEN doc_id % 5 <> 0
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) END AS date_taken,
         CASE WHEN doc_id % 7 <> 0 THEN 640 + doc_id % 100 END AS width,
         CASE WHEN doc_id % 7 <> 0 THEN 480 + doc_id % 50 END AS height,
         ['Canon EOS 5D', 'NIKON: D850', 'A/B\C*?', '  Pixel 8  ', '???', NULL][doc_id % 6 + 1]
           AS camera_model
  FROM (
    SELECT doc_id, text, source, CAST(strlen(text) AS BIGINT) AS file_size, extension,
           CASE WHEN (doc_id // 70) % 2 = 0 THEN 'IMG_' ELSE 'img_' END
             || lpad(CAST(doc_id % 70 AS VARCHAR), 4, '0') || '.' || extension AS file_name
    FROM (
      SELECT *, ['jpg','jpeg','png','heic','tif','raw','cr2','nef','mp4','mov','3gp','webm',
                 'txt','pdf'][doc_id % 14 + 1] AS extension
      FROM documents)))
"""
MEDIA = _MEDIA.format(gate="9223372036854775807")
GATED = _MEDIA.format(gate="20000")

# Extension lists.
_IMAGES = "('jpg','jpeg','png','gif','bmp','webp','heic','heif','tiff','tif')"
_VIDEOS = "('mp4','mov','avi','mkv','wmv','flv','webm','m4v')"
_SCAN_IMAGES = (
    "('jpg','jpeg','png','gif','bmp','webp','heic','heif','tiff','tif','raw','cr2','nef','arw','dng')"
)
_SCAN_VIDEOS = "('mp4','mov','avi','mkv','wmv','flv','webm','m4v','3gp')"

# The sequential rule itself: one row at a time, carrying the leaders so far.
_WALK = """
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS leader,
         CAST([] AS STRUCT(p BIGINT, h UBIGINT)[]) AS leads
  UNION ALL
  SELECT rn, pos, coalesce(hit.p, pos),
         CASE WHEN hit IS NULL THEN list_append(leads, struct_pack(p := pos, h := h)) ELSE leads END
  FROM (
    SELECT c.rn, c.pos, c.h, w.leads,
           list_filter(w.leads, lambda l: bit_count(xor(l.h, c.h)) <= {t})[1] AS hit
    FROM walk w JOIN candidates c ON c.rn = w.rn + 1)),
led AS (SELECT pos, leader FROM walk WHERE rn > 0)
"""

_CANDIDATES = f"""
candidates AS (
  SELECT row_number() OVER (ORDER BY pos) AS rn, pos, phash AS h
  FROM media WHERE extension IN {_IMAGES})
"""

_GROUPS = """
exact AS (
  SELECT 'exact:' || sha256_hash AS group_id, 'exact' AS duplicate_type, sha256_hash AS hash,
         count(*) AS n_files, CAST(sum(file_size) - max(file_size) AS BIGINT) AS wasted_space,
         count(*) - 1 AS removable_count
  FROM media WHERE sha256_hash IS NOT NULL GROUP BY sha256_hash HAVING count(*) > 1),
names AS (
  SELECT 'name:' || lower(file_name) AS group_id, 'nameMatch' AS duplicate_type,
         CAST(NULL AS VARCHAR) AS hash, count(*) AS n_files,
         CAST(sum(file_size) - max(file_size) AS BIGINT) AS wasted_space,
         CAST(0 AS BIGINT) AS removable_count
  FROM media GROUP BY lower(file_name)
  HAVING count(*) > 1 AND count(DISTINCT sha256_hash) > 1)
"""

_SIMILAR = """
similar_ AS (
  SELECT 'similar:' || leader AS group_id, 'similar' AS duplicate_type,
         CAST(NULL AS VARCHAR) AS hash, count(*) AS n_files,
         CAST(sum(file_size) - max(file_size) AS BIGINT) AS wasted_space,
         count(*) - 1 AS removable_count
  FROM led JOIN media USING (pos) GROUP BY leader HAVING count(*) > 1)
"""

_MEMBERS = """
members AS (
  SELECT group_id, duplicate_type, n_files, m.*
  FROM exact JOIN media m ON exact.hash = m.sha256_hash
  UNION ALL
  SELECT group_id, duplicate_type, n_files, m.*
  FROM similar_ JOIN led ON group_id = 'similar:' || leader JOIN media m USING (pos)
  UNION ALL
  SELECT group_id, duplicate_type, n_files, m.*
  FROM names JOIN media m ON group_id = 'name:' || lower(m.file_name))
"""

_BEST = """
sized AS (SELECT *, max(file_size) OVER (PARTITION BY group_id) AS top FROM members),
firsts AS (
  SELECT *, first_value(date_taken) OVER (PARTITION BY group_id ORDER BY pos) AS first_date
  FROM sized WHERE file_size = top),
best AS (
  SELECT group_id, duplicate_type, n_files, pos AS best_pos
  FROM firsts
  QUALIFY row_number() OVER (
    PARTITION BY group_id
    ORDER BY CASE WHEN first_date IS NULL THEN pos END, date_taken DESC NULLS LAST, pos) = 1),
doomed AS (
  SELECT DISTINCT m.pos FROM members m JOIN best b USING (group_id)
  WHERE m.duplicate_type <> 'nameMatch' AND m.pos <> b.best_pos)
"""

_ALL = ",".join([_CANDIDATES, _WALK.format(t=10), _GROUPS, _SIMILAR, _MEMBERS, _BEST])


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"


_FULL = _with(MEDIA, _ALL, recursive=True)

_GROUP_COLS = "group_id, duplicate_type, hash, n_files, wasted_space, removable_count"

_CELLS = """
grids AS (
  SELECT vec_id, list_transform(embedding, lambda v:
    CAST(floor((greatest(least(CAST(v AS DOUBLE), 1.0), -1.0) + 1.0) * 127.5) AS INTEGER)) AS cells
  FROM embeddings)
"""


def _hash_of(cells: str) -> str:
    """64-bit average hash of a list of cells, as UBIGINT."""
    return (
        f"list_sum(list_transform(range(64), lambda i: CASE WHEN {cells}[i + 1] > "
        f"list_sum({cells}) // 64 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) "
        f"ELSE CAST(0 AS HUGEINT) END))"
    )


def _hex(value: str) -> str:
    return f"lpad(lower(to_hex(CAST({value} AS UBIGINT))), 16, '0')"


_PIXELS = """
pixels AS (
  SELECT vec_id, x, y, cells[(y // 2) * 8 + (x // 2) + 1] + 4 * ((x + y) % 2) AS luma
  FROM grids, range(16) AS xs(x), range(16) AS ys(y)),
boxes AS (
  SELECT vec_id, (y * 8 // 16) * 8 + (x * 8 // 16) AS cell,
         CAST(floor(avg(luma) + 0.5) AS INTEGER) AS mean
  FROM pixels GROUP BY ALL)
"""


# Lanczos weights of 16 samples for 8 cells in 2^20ths, columns first, then rows.
_RESAMPLED = """
offsets AS (SELECT i, c, ((2 * i + 1) * 8 - (2 * c + 1) * 16) / 32.0::DOUBLE AS t FROM range(16) AS s(i), range(8) AS o(c)),
kernel AS (
  SELECT i, c, CASE WHEN t = 0 THEN 1048576 WHEN abs(t) < 3 THEN CAST(floor(
    sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) * 1048576 + 0.5) AS BIGINT) ELSE 0 END AS w
  FROM offsets),
down AS (
  SELECT vec_id, x, c AS r, 2 * 65536 * sum(w * luma) + sum(w) AS a, 2 * sum(w) AS b
  FROM pixels JOIN kernel ON i = y GROUP BY ALL),
lines AS (SELECT vec_id, x, r, (a - ((a % b) + b) % b) // b AS v FROM down),
across AS (
  SELECT vec_id, r, c, 2 * sum(w * v) + 65536 * sum(w) AS a, 2 * 65536 * sum(w) AS b
  FROM lines JOIN kernel ON i = x GROUP BY ALL),
resampled AS (
  SELECT vec_id, r * 8 + c AS cell, CAST(least(greatest((a - ((a % b) + b) % b) // b, 0), 255) AS INTEGER) AS value
  FROM across)
"""


def _size_text(size: str) -> str:
    def part(power: int, unit: str) -> str:
        return (
            f"replace(CAST(CAST(round({size} / {1024 ** power}.0, 1) AS DECIMAL(20, 1)) AS VARCHAR)"
            f" || ' {unit}', '.0 ', ' ')"
        )
    return (
        f"CASE WHEN {size} < 1024 THEN {size} || ' B' "
        f"WHEN {size} < {1024 ** 2} THEN {part(1, 'KB')} "
        f"WHEN {size} < {1024 ** 3} THEN {part(2, 'MB')} "
        f"WHEN {size} < {1024 ** 4} THEN {part(3, 'GB')} ELSE {part(4, 'TB')} END"
    )


def _eta_text(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL OR {s} = 0 THEN '--:--' "
        f"WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60) "
        f"ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"
    )


_CLEAN_CAMERA = r"trim(regexp_replace(camera_model, '[/\\:*?\"<>|]', '_', 'g'))"
_DAY = "coalesce(CAST(date_taken AS DATE), DATE '2024-06-15')"
_TYPE_FOLDER = (
    f"CASE WHEN extension IN {_IMAGES} THEN 'Images' "
    f"WHEN extension IN {_VIDEOS} THEN 'Videos' ELSE 'Other' END"
)
_FOLDERS = {
    "dest_by_date_ymd": f"strftime({_DAY}, '%Y/%m/%d')",
    "dest_by_date_ym": f"strftime({_DAY}, '%Y/%m')",
    "dest_by_date_y": f"strftime({_DAY}, '%Y')",
    "dest_by_date_flat": f"strftime({_DAY}, '%Y-%m-%d')",
    "dest_by_camera": f"coalesce({_CLEAN_CAMERA}, 'Unknown')",
    "dest_by_type": _TYPE_FOLDER,
    "dest_custom": (
        "replace(CASE WHEN camera_model IS NULL THEN p ELSE replace(p, '{camera}', "
        f"{_CLEAN_CAMERA}) END, '{{type}}', upper(extension))"
    ),
}


def _labelled(pairs: list[tuple[str, str]]) -> str:
    return _with(MEDIA) + " UNION ALL ".join(
        f"SELECT pos, '{label}' AS strategy, '/library/' || {folder} || '/' || file_name"
        " AS destination FROM media"
        for label, folder in pairs
    )


_PLAN = f"""
dests AS (
  SELECT pos, file_name, path AS source,
         '/library/' || {_FOLDERS['dest_by_camera']} || '/' || file_name AS destination
  FROM media),
existing AS (
  SELECT DISTINCT destination FROM dests JOIN labels ON doc_id = pos WHERE quality = 1),
plan AS (
  SELECT pos, file_name, source, destination, 'move' AS operation_type,
         row_number() OVER (PARTITION BY destination ORDER BY pos) > 1
           OR destination IN (SELECT destination FROM existing) AS conflict
  FROM dests),
found AS (
  SELECT *, pos NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS has_source,
         destination IN (SELECT destination FROM existing) AS there
  FROM dests),
judged AS (
  SELECT *, there OR coalesce(sum(CASE WHEN has_source THEN 1 ELSE 0 END) OVER (
      PARTITION BY destination ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS taken
  FROM found),
outcomes AS (
  SELECT pos, file_name,
         CASE WHEN taken THEN 'skipped' WHEN NOT has_source THEN 'failed' ELSE 'moved' END
           AS outcome,
         CASE WHEN taken THEN 'Destination already exists for ' || file_name || ' - skipping'
              WHEN NOT has_source THEN 'Failed to move ' || file_name || ': source not found' END
           AS message
  FROM judged)
"""
_PLANNED = _with(MEDIA, _PLAN)

_PARENT = "regexp_extract(destination, '^(.*)/[^/]*$', 1)"

_TAGS = f"""
tags AS (
  SELECT path, tag, value, file_size FROM (
    SELECT path, file_size, pos,
           unnest(['DateTimeOriginal', 'PixelXDimension', 'PixelYDimension', 'Model', 'Software']) AS tag,
           unnest([CASE WHEN pos % 11 <> 0 THEN strftime(date_taken, '%Y:%m:%d %H:%M:%S') END,
                   CASE WHEN pos % 11 <> 0 THEN CAST(width AS VARCHAR) END,
                   CASE WHEN pos % 11 <> 0 THEN CAST(height AS VARCHAR) END,
                   CASE WHEN pos % 11 <> 0 THEN camera_model END,
                   CASE WHEN pos % 11 = 0 OR pos % 3 = 0 THEN '1.0' END]) AS value
    FROM media WHERE extension IN {_IMAGES} AND file_size < 10485760)
  WHERE value IS NOT NULL),
known AS (
  SELECT path,
         max(CASE WHEN tag = 'DateTimeOriginal' THEN
             strftime(strptime(value, '%Y:%m:%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END) AS taken,
         max(CASE WHEN tag = 'PixelXDimension' THEN CAST(value AS BIGINT) END) AS width,
         max(CASE WHEN tag = 'PixelYDimension' THEN CAST(value AS BIGINT) END) AS height,
         max(CASE WHEN tag = 'Model' THEN value END) AS camera_model
  FROM tags GROUP BY path)
"""

_PROGRESS = f"""
numbered AS (
  SELECT event_type AS scan_id, CAST(event_id AS VARCHAR) AS current_file,
         row_number() OVER run AS current, count(*) OVER (PARTITION BY event_type) AS total,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1000000.0 AS elapsed
  FROM events WINDOW run AS (PARTITION BY event_type ORDER BY ts, event_id)),
paced AS (
  SELECT *, CASE WHEN elapsed > 0 THEN CAST(current AS DOUBLE) / elapsed ELSE 0.0 END AS pace
  FROM numbered),
timed AS (
  SELECT *, CASE WHEN pace > 0 THEN CAST(floor((total - current) / pace) AS BIGINT) END AS eta
  FROM paced),
per_file AS (
  SELECT scan_id, current + 2 AS step, 'Hashing' AS phase, current, total, current_file,
         round(pace, 6) AS speed, eta AS eta_seconds FROM timed),
runs AS (SELECT event_type AS scan_id, count(*) AS n FROM events GROUP BY 1),
whole_run AS (
  SELECT scan_id, 0 AS step, 'Initializing' AS phase, 0 AS current, 0 AS total, NULL AS current_file FROM runs
  UNION ALL SELECT scan_id, 1, 'Scanning', 0, 1, NULL FROM runs
  UNION ALL SELECT scan_id, 2, 'Scanning', 1, n, 'Found ' || n || ' files' FROM runs
  UNION ALL SELECT scan_id, n + 3, 'Complete', n, n, NULL FROM runs),
all_records AS (
  SELECT * FROM per_file WHERE (current - 1) % 10 = 0 OR current = total
  UNION ALL
  SELECT *, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM whole_run),
records AS (
  SELECT *, CASE WHEN total = 0 THEN 0
                 ELSE CAST(floor(CAST(current AS DOUBLE) / total * 100 + 0.5) AS BIGINT) END AS percent,
         CASE WHEN speed IS NOT NULL THEN printf('%.1f files/sec', speed) END AS speed_text,
         {_eta_text('eta_seconds')} AS eta_text
  FROM all_records)
"""

ORACLE: dict[str, str] = {
    "exact_duplicates": _with(MEDIA, _GROUPS) + f"SELECT {_GROUP_COLS} FROM exact",
    "name_matches": _with(MEDIA, _GROUPS)
    + "SELECT group_id, duplicate_type, n_files, wasted_space, removable_count FROM names",
    "gated_exact_duplicates": _with(GATED, _GROUPS) + f"SELECT {_GROUP_COLS} FROM exact",
    "hamming_pairs": _with(MEDIA) + """,
hashes AS (SELECT phash, min(pos) AS pos FROM media GROUP BY phash)
SELECT a.pos AS lo, b.pos AS hi, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance
FROM hashes a JOIN hashes b ON a.pos < b.pos AND bit_count(xor(a.phash, b.phash)) <= 10""",
    "similar_groups": _FULL
    + "SELECT group_id, duplicate_type, n_files, wasted_space, removable_count FROM similar_",
    "similar_groups_dense": _FULL
    + "SELECT group_id, duplicate_type, n_files, wasted_space, removable_count FROM similar_",
    "similar_vectors": _with(
        _CELLS,
        f"candidates AS (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id AS pos, "
        f"CAST({_hash_of('cells')} AS UBIGINT) AS h FROM grids)",
        _WALK.format(t=18), recursive=True,
    ) + "SELECT leader, count(*) AS n_files FROM led GROUP BY leader HAVING count(*) > 1",
    "duplicate_groups": _FULL + " UNION ALL ".join(
        f"SELECT {_GROUP_COLS} FROM {t}" for t in ("exact", "similar_", "names")
    ),
    "duplicate_totals": _FULL + """,
everything AS (SELECT * FROM exact UNION ALL SELECT * FROM similar_ UNION ALL SELECT * FROM names)
SELECT CAST(coalesce(sum(CASE WHEN duplicate_type <> 'nameMatch' THEN wasted_space END), 0)
            AS BIGINT) AS total_wasted_space,
       count(*) AS total_groups,
       count(*) FILTER (duplicate_type = 'exact') AS exact_groups,
       count(*) FILTER (duplicate_type = 'similar') AS similar_groups,
       count(*) FILTER (duplicate_type = 'nameMatch') AS name_groups
FROM everything""",
    "group_members": _FULL + """
SELECT group_id, duplicate_type,
       (row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1) // 25 AS chunk_no,
       pos, id, file_name, file_size FROM members""",
    "name_members": _FULL + """
SELECT group_id, pos, file_name, file_size FROM members WHERE duplicate_type = 'nameMatch'""",
    "gated_hashes": _with(GATED) + "SELECT pos, file_size, md5_hash, sha256_hash FROM media",
    "hash_coverage": _with(GATED) + """
SELECT count(*) AS n_files, count(sha256_hash) AS with_sha256, count(md5_hash) AS with_md5
FROM media""",
    "hash_preview": _with(MEDIA) + """
SELECT pos, file_name, substr(sha256_hash, 1, 16) AS hash_prefix FROM media ORDER BY pos LIMIT 3""",
    "average_hash": _with(_CELLS)
    + f"SELECT vec_id AS pos, {_hex(_hash_of('cells'))} AS phash FROM grids",
    "grid_reduce": _with(_CELLS, _PIXELS) + """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(cell AS INTEGER) AS cell, mean FROM boxes""",
    "grid_hashes": _with(
        _CELLS, _PIXELS,
        "lists AS (SELECT vec_id, list(mean ORDER BY cell) AS means FROM boxes GROUP BY vec_id)",
    ) + f"SELECT CAST(vec_id AS VARCHAR) AS id, {_hex(_hash_of('means'))} AS phash FROM lists",
    "lanczos_reduce": _with(_CELLS, _PIXELS, _RESAMPLED) + """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(cell AS INTEGER) AS cell, value FROM resampled""",
    "lanczos_hashes": _with(
        _CELLS, _PIXELS, _RESAMPLED,
        "lists AS (SELECT vec_id, list(value ORDER BY cell) AS means FROM resampled GROUP BY vec_id)",
    ) + f"SELECT CAST(vec_id AS VARCHAR) AS id, {_hex(_hash_of('means'))} AS phash FROM lists",
    "classify_media": _with(MEDIA) + f"""
SELECT pos, file_name AS name, extension AS ext, lower(file_name) AS name_key,
       extension IN {_SCAN_IMAGES} OR extension IN {_SCAN_VIDEOS} AS is_media,
       extension IN {_IMAGES} AS is_image, extension IN {_VIDEOS} AS is_video,
       {_TYPE_FOLDER} AS type_folder
FROM media""",
    "category_summary": _with(MEDIA) + f"""
SELECT CASE WHEN extension IN {_SCAN_IMAGES} THEN 'image' ELSE 'video' END AS category,
       count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes,
       printf('%.2f MB', CAST(sum(file_size) AS DOUBLE) / 1048576) AS total_size
FROM media WHERE extension IN {_SCAN_IMAGES} OR extension IN {_SCAN_VIDEOS} GROUP BY 1""",
    "library_stats": _with(GATED) + f"""
SELECT n_files, total_bytes, n_hashed, {_size_text('total_bytes')} AS total_size
FROM (SELECT count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes,
             count(md5_hash) AS n_hashed FROM media)""",
    "display_text": _with(MEDIA) + f"""
SELECT pos, {_size_text('file_size')} AS size_text,
       {_size_text('(file_size * pos * 1000)')} AS scaled_text,
       printf('%.2f MB', file_size / 1048576.0) AS mb_text,
       width || '×' || height AS dimensions,
       strftime(date_taken, '%Y-%m-%d') AS day,
       {_eta_text('file_size')} AS eta_text
FROM media""",
    "file_preview": _with(MEDIA) + """
SELECT pos, path, file_size, (SELECT greatest(count(*) - 10, 0) FROM media) AS n_more
FROM media ORDER BY pos LIMIT 10""",
    "page_slice": _with(MEDIA) + """
SELECT pos, file_name, (row_number() OVER (ORDER BY pos) - 1) // 48 AS page,
       (row_number() OVER (ORDER BY pos) - 1) % 48 AS slot FROM media""",
    "page_read": _with(MEDIA) + """
SELECT pos, file_name, (n - 1) // 48 AS page, (n - 1) % 48 AS slot
FROM (SELECT pos, file_name, row_number() OVER (ORDER BY pos) AS n, count(*) OVER () AS total FROM media)
WHERE (n - 1) // 48 IN (1, (total - 1) // 48)""",
    "range_select": _with(MEDIA) + """,
ends AS (
  (SELECT pos FROM media ORDER BY file_size DESC, pos DESC LIMIT 1) UNION ALL
  (SELECT pos FROM media ORDER BY file_size, pos LIMIT 1))
SELECT pos, file_name FROM media
WHERE pos BETWEEN (SELECT min(pos) FROM ends) AND (SELECT max(pos) FROM ends)""",
    "keep_best": _FULL + "SELECT group_id, duplicate_type, n_files, best_pos FROM best",
    "best_flags": _FULL + """
SELECT group_id, pos, file_size, pos = best_pos AS is_best
FROM members JOIN best USING (group_id) WHERE members.duplicate_type = 'exact'""",
    "deletion_plan": _FULL + """
SELECT pos, path, file_size FROM media WHERE pos IN (SELECT pos FROM doomed)""",
    "catalog_after_delete": _FULL + """
SELECT pos, path, file_size FROM media WHERE pos NOT IN (SELECT pos FROM doomed)""",
    "marked_files": _FULL + """
SELECT pos, id, pos IN (
  SELECT m.pos FROM members m JOIN best b USING (group_id)
  WHERE m.duplicate_type = 'exact' AND m.pos <> b.best_pos) AS selected FROM media""",
    "toggle_keys": _with(MEDIA, _GROUPS) + f""",
a AS (SELECT id FROM media WHERE extension IN {_IMAGES} AND file_size < 10485760),
b AS (SELECT id FROM media WHERE sha256_hash IN (SELECT hash FROM exact))
(SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)""",
    "union_keys": _with(MEDIA, _GROUPS) + f"""
SELECT id FROM media WHERE extension IN {_IMAGES} AND file_size < 10485760
UNION SELECT id FROM media WHERE sha256_hash IN (SELECT hash FROM exact)""",
    "root_union": """
WITH a AS (SELECT source AS root, min(doc_id) AS pos FROM documents WHERE lang = 'en' GROUP BY 1),
b AS (SELECT source AS root, min(doc_id) AS pos FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT pos, root FROM (
  SELECT pos, root FROM a UNION ALL
  SELECT pos + 1 + (SELECT max(pos) FROM a), root FROM b WHERE root NOT IN (SELECT root FROM a))
WHERE root <> 'src3'""",
    "append_batches": _with(MEDIA) + """
SELECT pos, id, path, file_name, file_size, extension, md5_hash, width,
       false AS is_blurry, false AS is_burst_leader FROM media
UNION ALL
SELECT page_id, '', url, '', CAST(strlen(html) AS BIGINT), '', NULL, NULL, false, false
FROM pages""",
    "json_roundtrip": _with(MEDIA) + f"""
SELECT pos, id, path, file_name, file_size, sha256_hash, {_hex('phash')} AS phash,
       strftime(date_taken, '%Y-%m-%d %H:%M:%S') AS taken, width, camera_model,
       false AS is_blurry
FROM media""",
    "json_documents": _with(MEDIA, _GROUPS) + """
SELECT '{"groupId":"' || group_id || '","duplicateType":"exact","hash":"' || hash
       || '","nFiles":' || n_files || ',"wastedSpace":' || wasted_space
       || ',"removableCount":' || removable_count || '}' AS json FROM exact""",
    "dest_by_location": _labelled([
        ("country", "'ByCountry'"), ("city", "'ByCity'"), ("exact", "'ByGPS'"),
    ]),
    "dest_by_preset": _labelled([
        ("By Date (Year/Month/Day)", _FOLDERS["dest_by_date_ymd"]),
        ("By Date (Year/Month)", _FOLDERS["dest_by_date_ym"]),
        ("By Camera", _FOLDERS["dest_by_camera"]),
        ("By File Type", _FOLDERS["dest_by_type"]),
    ]),
    "dest_custom": _with(MEDIA) + f"""
SELECT pos, '/library/' || {_FOLDERS['dest_custom']} || '/' || file_name AS destination
FROM (SELECT *, coalesce(strftime(date_taken, '%Y/%m-%d'), '{{year}}/{{month}}-{{day}}')
        || '/{{camera}}/{{type}}' AS p FROM media)""",
    "dest_custom_rooted": _with(MEDIA) + """
SELECT pos, '/archive/' || upper(extension) || '/'
       || coalesce(strftime(date_taken, '%Y'), '{year}') || '/' || file_name AS destination
FROM media""",
    "organize_preview": _PLANNED + "SELECT * FROM plan",
    "organize_outcome": _PLANNED + "SELECT * FROM outcomes",
    "outcome_counts": _PLANNED + """
SELECT 'task-1' AS task_id, CAST(0 AS BIGINT) AS files_moved,
       count(*) FILTER (outcome = 'moved') AS files_copied, count(message) AS n_errors,
       '/library' AS destination_path FROM outcomes""",
    "error_lists": _PLANNED + """
SELECT chunk_no, string_agg(message, '|' ORDER BY pos) AS errors
FROM (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 25 AS chunk_no
      FROM outcomes WHERE message IS NOT NULL) GROUP BY chunk_no""",
    "conflict_summary": _PLANNED + f"""
SELECT count(*) AS total_files, count(DISTINCT {_PARENT}) AS n_folders,
       count(*) FILTER (conflict) AS would_overwrite FROM plan""",
    "first_conflicts": _PLANNED
    + """SELECT pos, file_name, greatest((SELECT count(*) FROM plan WHERE conflict) - 5, 0) AS n_more
FROM plan WHERE conflict ORDER BY pos LIMIT 5""",
    "folder_counts": _PLANNED + f"""
SELECT {_PARENT} AS folder, count(*) AS n_files, min(pos) AS first_pos FROM plan GROUP BY 1""",
    "folder_summary": _with(MEDIA) + f""",
dated AS (SELECT pos, path, file_name, '/library/' || {_FOLDERS['dest_by_date_ymd']} AS folder
          FROM media),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY folder) AS n_files,
         min(pos) OVER (PARTITION BY folder) AS first_pos,
         row_number() OVER (PARTITION BY folder ORDER BY pos) AS place FROM dated),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY first_pos) AS folder_no FROM counted)
SELECT folder, CAST(place AS INTEGER) AS place, pos, split_part(path, '/', -1) AS source_name,
       file_name AS destination_name, n_files, greatest(n_files - 3, 0) AS n_more,
       greatest((SELECT max(folder_no) FROM ranked) - 10, 0) AS more_folders
FROM ranked WHERE folder_no <= 10 AND place <= 3""",
    "layout_write": _with(MEDIA) + f"""
SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_bytes
FROM (SELECT {_DAY} AS d, file_size FROM media) GROUP BY 1, 2""",
    "parse_capture_time": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 IN (3, 5, 6) THEN NULL
            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS taken
FROM orders""",
    "tag_projection": _with(MEDIA, _TAGS) + "SELECT * FROM known",
    "gated_tag_projection": _with(MEDIA, _TAGS)
    + "SELECT * FROM known WHERE path IN (SELECT path FROM media WHERE file_size < 2000)",
    "scan_documents": """
WITH files AS (SELECT doc_id, coalesce(text, '') || chr(10) AS body FROM documents),
sized AS (SELECT *, octet_length(encode(body)) AS file_size FROM files)
SELECT doc_id, file_size, 'txt' AS extension,
       CASE WHEN file_size < 3000 THEN md5(body) END AS md5_hash,
       CASE WHEN file_size < 3000 THEN sha256(body) END AS sha256_hash, true AS indexed
FROM sized""",
    "metadata_fill": _with(MEDIA, _TAGS) + """
SELECT m.pos, k.taken,
       CASE WHEN k.path IS NOT NULL THEN coalesce(k.width, length(m.file_name)) END AS width,
       CASE WHEN k.path IS NOT NULL THEN coalesce(k.height, length(m.path)) END AS height,
       k.camera_model
FROM media m LEFT JOIN known k USING (path)""",
    "progress_series": _with(_PROGRESS)
    + "SELECT * FROM records",
    "progress_records": _with(_PROGRESS)
    + "SELECT * FROM records",
    "layout_repeat": _with(
        MEDIA, f"planned AS (SELECT {_FOLDERS['dest_by_type']} || '/' || file_name AS destination FROM media)",
        "n AS (SELECT count(*) AS files, count(DISTINCT destination) AS places FROM planned)",
    ) + """SELECT * FROM (
  SELECT 1 AS run, 'moved' AS outcome, places AS n_files FROM n
  UNION ALL SELECT 1, 'skipped', files - places FROM n
  UNION ALL SELECT 2, 'skipped', files FROM n
  UNION ALL SELECT 2, 'held', places FROM n) WHERE n_files > 0""",
    "progress_stream": _with(_PROGRESS) + "SELECT * FROM records WHERE phase = 'Complete'",
}
ORACLE.update({
    name: _with(MEDIA)
    + f"SELECT pos, '/library/' || {folder} || '/' || file_name AS destination FROM media"
    for name, folder in _FOLDERS.items() if name != "dest_custom"
})
