"""JSON text functions. Objects are held as text with their keys sorted, values as compact JSON.

Reading and building stay in Catalyst; the few functions that rewrite nested documents take an Arrow-batched UDF
(tessera.functions.json_udf), for Catalyst has no primitive for them.
"""


def _path(keys):
    return "$" + "".join(f"[{k}]" if k.lstrip("-").isdigit() else f".{k}" for k in (x.strip("'") for x in keys))


FUNCTIONS = {
    "jsonb_build_object": lambda *a: "to_json(named_struct(" + ", ".join(x for _, p in sorted((a[k], f"{a[k]}, {a[k + 1]}") for k in range(0, len(a), 2)) for x in [p]) + "))",
    "jsonb_build_array": lambda *a: f"to_json(array({', '.join(a)}))",
    "jsonb_typeof": lambda j: f"CASE WHEN {j} RLIKE '^\\\\s*\\\\{{' THEN 'object' WHEN {j} RLIKE '^\\\\s*\\\\[' THEN 'array' WHEN {j} RLIKE '^\\\\s*\"' THEN 'string' WHEN trim({j}) IN ('true', 'false') THEN 'boolean' WHEN trim({j}) = 'null' THEN 'null' ELSE 'number' END",
    "jsonb_array_length": "CAST(json_array_length({}) AS BIGINT)".format, "jsonb_extract_path": lambda j, *k: f"get_json_object({j}, '{_path(k)}')", "jsonb_extract_path_text": lambda j, *k: f"get_json_object({j}, '{_path(k)}')",
    "jsonb_object_keys": "array_sort(json_object_keys({}))".format, "to_jsonb": "to_json({})".format, "row_to_json": "to_json({})".format, "jsonb_array_elements": "from_json({}, 'array<string>')".format, "jsonb_array_elements_text": "from_json({}, 'array<string>')".format,
    "jsonb_each": "flatten(transform(array_sort(map_entries(from_json({}, 'map<string,string>'))), e -> array(e.key, e.value)))".format, "jsonb_each_text": "flatten(transform(array_sort(map_entries(from_json({}, 'map<string,string>'))), e -> array(e.key, e.value)))".format,
    "jsonb_delete_key": lambda j, k: f"to_json(map_filter(from_json({j}, 'map<string,variant>'), (a, b) -> a <> {k}))", "jsonb_agg": "to_json(collect_list({}))".format, "jsonb_populate_record": "from_json({}, {})".format, "jsonb_exists": "array_contains(json_object_keys({}), {})".format,
}
