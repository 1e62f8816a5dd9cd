"""Invented scan deliveries, and a version of the fold that takes them one by one."""

from datetime import datetime, timedelta

MINUTE = timedelta(minutes=1)


def invented(rng, sources=6, scans=12, listings=40, connectors=2, burst=0):
    """Deliveries and observations; with ``burst`` all sources collapse at about that scan, within minutes."""
    deliveries, observations = [], []
    for s in range(sources):
        at = datetime(2024, 1, 1) + rng.randrange(20) * MINUTE
        alive = [x for x in range(listings) if rng.random() < 0.8]
        for k in range(scans):
            at += (30 + rng.randrange(2) if burst else rng.choice([5, 10, 20, 30, 31, 60, 240])) * MINUTE
            luck = rng.random()
            failed = luck < 0.08
            reason = rng.choice(["blocked", "transport_failure"]) if failed else "pagination_incomplete" if luck < 0.2 else "complete"
            share = 0.04 if burst and k == burst + s % 2 else rng.choice([0.9, 0.9, 0.7, 0.5, 0.95, 0.05 if rng.random() < 0.3 else 0.8])
            seen = [] if failed or rng.random() < 0.02 else [x for x in alive if rng.random() < share]
            name = f"s{s}-{k:03d}"
            deliveries.append((name, f"src{s}", f"c{s % connectors}", f"job{s}", k, at - MINUTE, at, reason, failed, 100, ["a", "b"], None))
            observations += [(name, f"l{x}", f"v{rng.choice([0, 0, 0, k % 3])}", "a", [("/title", '"x"', "source_field", 1.0)]) for x in seen]
    return deliveries, observations


class OneByOne:
    """The ledger as plain dictionaries, changed scan by scan in order of time."""

    def __init__(self):
        self.sources, self.listings, self.versions, self.held, self.trips = {}, {}, set(), {}, []
        self.scans, self.events = [], []

    def run(self, deliveries, observations):
        seen = {}
        for scan, listing, version, *_ in observations:
            seen.setdefault(scan, {})[listing] = version
        for d in sorted(deliveries, key=lambda r: (r[6], r[0])):
            self.take(d, seen.get(d[0], {}))
        return self

    def tell(self, source, listing, event, at, scan):
        state = self.listings[source, listing]
        state["seq"] += 1
        self.events.append((source, listing, state["seq"], event, at, scan))

    def trip(self, z, connector, source, at, seen, active):
        base, missing = max(z["last"] or 0, active), max(0, active - len(seen))
        why = None
        if base >= 10 and not seen:
            why = "suspicious_empty"
        elif base >= 10 and round((base - len(seen)) / base, 4) >= 0.9:
            why = "count_collapse"
        elif missing >= 50 and missing / active >= 0.5:
            why = "closure_spike"
        if why:
            z["tripped"] = at
            self.trips.append((at, connector))
            if sum(c == connector and at - t <= 15 * MINUTE for t, c in self.trips) >= 3:
                self.held[connector] = at
                for other in self.sources.values():
                    if other["connector"] == connector:
                        other["health"] = "quarantined"
        return why

    def take(self, delivery, seen):
        scan, source, connector, _, _, _, at, reason, failed, *_ = delivery
        z = self.sources.setdefault(source, dict(connector=connector, last=None, tripped=None, failures=0, empty=0, health=None, complete=None, full=None, next=None))
        complete = reason == "complete" and not failed
        broken, why = z["tripped"] is not None or connector in self.held, None
        if complete and not broken:
            active = sum(v["state"] != "closed" for (s, _), v in self.listings.items() if s == source)
            why = self.trip(z, connector, source, at, seen, active)
            broken = why is not None
        counts = dict(added=0, changed=0, missing=0, reopened=0, closed=0, versions=0)
        for listing, version in seen.items():
            if (source, listing) not in self.listings:
                self.listings[source, listing] = dict(state="active", seq=0, first=at, version=None, reopened=None)
                counts["added"] += 1
                self.tell(source, listing, "opened", at, scan)
            state = self.listings[source, listing]
            if state["state"] != "active":
                counts["reopened"] += 1
                state["reopened"] = at
                self.tell(source, listing, "reopened", at, scan)
            counts["versions"] += (source, listing, version) not in self.versions
            counts["changed"] += state["version"] not in (None, version)
            self.versions.add((source, listing, version))
            state.update(state="active", misses=0, missing=None, closed=None, seen=at, version=version)
        if complete and not broken:
            for (s, listing), state in self.listings.items():
                if s == source and listing not in seen and state["state"] != "closed":
                    counts["missing"] += 1
                    state["misses"] += 1
                    if state["state"] == "active":
                        state.update(state="possibly_closed", missing=at)
                        self.tell(source, listing, "possibly_closed", at, scan)
                    elif at - state["missing"] >= 30 * MINUTE:
                        state.update(state="closed", closed=at)
                        counts["closed"] += 1
                        self.tell(source, listing, "closed", at, scan)
            if counts["missing"]:
                z["next"] = min(z["next"] or at + 30 * MINUTE, at + 30 * MINUTE)
        z["failures"] = 0 if complete else z["failures"] + 1
        z["health"] = "quarantined" if broken and not failed else "healthy" if complete else "blocked" if reason == "blocked" else "degraded"
        if not failed:
            z["last"] = len(seen)
            z["full"] = at if seen else z["full"]
        if complete:
            z["complete"], z["empty"] = at, 0 if seen else z["empty"] + 1
        self.scans.append((scan, len(seen), *counts.values(), complete and not broken, why))

    def tables(self):
        return {
            "scans": self.scans,
            "events": self.events,
            "listings": [(*k, v["state"], v["misses"], v["first"], v["seen"], v["missing"], v["closed"], v["reopened"], v["version"], v["seq"]) for k, v in self.listings.items()],
            "sources": [(s, z["health"], z["last"], z["failures"], z["empty"], z["complete"], z["full"], z["next"], z["tripped"], self.held.get(z["connector"])) for s, z in self.sources.items()],
            "versions": list(self.versions),
        }


COLUMNS = {
    "scans": ["scan_id", "observed", "added", "changed", "missing", "reopened", "closed", "versions", "eligible", "tripped"],
    "events": ["source", "listing", "sequence", "event", "at", "scan_id"],
    "listings": ["source", "listing", "status", "misses", "first_seen", "last_seen", "first_missing", "closed_at", "reopened_at", "current_version", "events"],
    "sources": ["source", "health", "last_job_count", "consecutive_failures", "complete_empty_scans", "last_complete_at", "last_nonempty_at", "next_scan_at", "tripped_at", "held_from"],
    "versions": ["source", "listing", "fingerprint"],
}
