"""The ordered resolution of a run said plainly: each row looks at the whole store that the rows before it left."""

import difflib
import re
import unicodedata
from datetime import datetime

VOLATILE = ("price", "is_free", "capacity_flag", "venue", "neighborhood", "address", "end", "status", "signup_url", "age_min", "age_max")


def norm(s):
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", s or "").lower()).strip()


def ratio(a, b):
    return difflib.SequenceMatcher(None, norm(a), norm(b)).ratio() if norm(a) and norm(b) else 0.0


def time(s):
    try:
        return datetime.fromisoformat((s or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None


def near(a, b):
    x, y = time(a), time(b)
    if x is None or y is None:
        return False
    if x.tzinfo is None or y.tzinfo is None:
        x, y = x.replace(tzinfo=None), y.replace(tzinfo=None)
    return abs((x - y).total_seconds()) <= 1800


def same(new, old):
    title = ratio(new["title"], old["title"])
    if not near(new["start"], old["start"]) or title < 0.88:
        return False
    address, venue = ratio(new["address"], old["address"]), ratio(new["venue"], old["venue"])
    if all(norm(e[c]) for e in (new, old) for c in ("venue", "address")) and venue < 0.7 and address < 0.7:
        return False
    area = title == 1 and norm(new["neighborhood"]) != "" and norm(new["neighborhood"]) == norm(old["neighborhood"])
    return address >= 0.92 or venue >= 0.9 or area or ratio(new["host"], old["host"]) >= 0.92


def replay(staged, events, aliases, seen):
    """Rows as dicts with canon_url and canon_signup; gives events and aliases as dicts, and (n, event, outcome)."""
    events, aliases, outcomes, taken = {e["id"]: dict(e) for e in events}, {(a["event_id"], a["canonical_url"]): dict(a) for a in aliases}, [], set()

    def find(new):
        moment = time(new["start"])
        if moment is not None:
            day = moment.date().isoformat()
            ids = {i for i, url in aliases if url in (new["canon_url"], new["canon_signup"])}
            found = [events[i] for i in ids if i in events and events[i]["start"][:10] == day]
            found = found if len(found) == 1 else [e for e in found if near(new["start"], e["start"])]
            if len(found) == 1:
                return found[0]
        if new["id"] in events:
            return events[new["id"]]
        found = [e for e in events.values() if moment is not None and e["start"][:10] == day and same(new, e)]
        return found[0] if len(found) == 1 else None

    def sight(event, canonical, url, source, first, last):
        if not canonical:
            return False
        old = aliases.get((event, canonical))
        if old is None:
            aliases[event, canonical] = {"event_id": event, "canonical_url": canonical, "url": url, "source_id": source or "", "first_seen": first, "last_seen": last}
            return True
        old.update(url=url or old["url"], source_id=old["source_id"] or source or "", first_seen=min(old["first_seen"], first), last_seen=max(old["last_seen"], last))
        return False

    def store(e):
        events[e["id"]] = e
        for c, url in (("canon_url", "url"), ("canon_signup", "signup_url")):
            sight(e["id"], e[c], e[url], e["source_id"], e["first_seen"], e["last_seen"])

    for new in sorted(staged, key=lambda r: r["n"]):
        new = dict(new)
        if not new["start"]:
            outcomes.append((new["n"], None, "rejected"))
            continue
        if time(new["start"]) is not None:
            new["start"] = time(new["start"]).isoformat()
        old = find(new)
        if old is None:
            old, outcome = {k: v for k, v in new.items() if k not in ("n", "raw_keys")}, "new"
            store(old)
        else:
            changed = False
            for c in VOLATILE:
                clears = c in ("is_free", "capacity_flag", "age_min", "age_max") and c in (new["raw_keys"] or ()) and old["source_id"] == new["source_id"]
                if (clears or new[c] not in (None, "", 0)) and old[c] != new[c]:
                    old[c], changed = new[c], True
                    if c == "signup_url":
                        old["canon_signup"] = new["canon_signup"]
            if len(new["description"]) > len(old["description"]):
                old["description"], changed = new["description"], True
            if not old["canon_url"] and new["canon_url"]:
                old.update(url=new["url"], canon_url=new["canon_url"])
                changed = True
            for c, url in (("canon_url", "url"), ("canon_signup", "signup_url")):
                changed |= sight(old["id"], new[c], new[url], new["source_id"], seen, seen)
            old["last_seen"] = seen
            store(old)
            outcome = "updated" if changed else "unchanged"
        outcomes.append((new["n"], old["id"], "duplicate" if old["id"] in taken else outcome))
        taken.add(old["id"])
    return list(events.values()), list(aliases.values()), outcomes
