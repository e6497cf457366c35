"""A note service of two pages, for the data source's workers to import."""


def note(i):
    return {"id": f"not_{i}", "object": "note", "title": None, "owner": {"name": None, "email": "o@x"}, "created_at": "2026-07-15T09:00:00Z", "updated_at": "2026-07-15T09:00:00Z"}


def service(path, params):
    if path == "/folders":
        return 200, {}, {"folders": [{"id": "fol_0", "object": "folder", "name": "A"}, {"id": "fol_1", "name": "B", "parent_folder_id": "fol_0"}], "hasMore": False}
    if path.startswith("/notes/"):
        known = path.removeprefix("/notes/") in {f"not_{i}" for i in range(4)}
        return (200, {}, note(int(path[-1]))) if known else (404, {}, {})
    at = int(params.get("cursor") or 0)
    return 200, {}, {"notes": [note(at), note(at + 1)], "hasMore": at == 0, "cursor": "2" if at == 0 else None}
