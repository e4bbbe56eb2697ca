"""The work ledger in SQL, from the notes of runs."""

LEDGER = r"""
newest AS (SELECT config_id, replace(rel_path, '\', '/') AS rel_path, max(struct_pack(a := scanned_at, b := file_id, m := mtime, f := file_path)) AS v FROM export_files GROUP BY ALL),
ok AS (SELECT s.config_id, replace(s.rel_path, '\', '/') AS rel_path, max(struct_pack(a := s.written_at, b := s.state_id, m := s.mtime)) AS w
  FROM index_state s JOIN (SELECT DISTINCT config_id, cache_file FROM configs) c ON s.config_id = c.config_id AND s.cache_file = c.cache_file
  JOIN index_runs r ON r.run_id = s.run_id AND r.run_status = 'success' WHERE s.schema_version = 4 GROUP BY ALL),
work AS (SELECT n.config_id, n.rel_path, v.f AS file_path, v.b AS file_id, v.m AS mtime, CASE WHEN w IS NOT NULL AND v.m IS NOT DISTINCT FROM w.m THEN 'done' ELSE 'pending' END AS state
  FROM newest n LEFT JOIN ok ON n.config_id = ok.config_id AND n.rel_path = ok.rel_path)
"""
