"""The projections in SQL, for the registered queries' independent counterparts."""

from __future__ import annotations

from flowlens.plans import dimensions
from flowlens.sources.projections import DOMAINS, MACS, PORTS


def quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + "]"


_D, _TLS = _list(DOMAINS), "event_type IN ('view', 'click', 'purchase')"

BASE = f"""
e AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS bu FROM events
), base AS (
  SELECT event_id, event_type, ts AS timestamp, epoch_us(ts) * 1000 AS first_seen, epoch_us(ts) * 1000 + k * 400000000 AS last_seen,
    CASE user_id % 10 WHEN 9 THEN '203.0.113.' || (user_id % 250) WHEN 8 THEN '10.0.' || (user_id % 7) || '.' || (user_id % 250)
      WHEN 7 THEN '172.20.0.' || (user_id % 250) ELSE '192.168.' || (user_id % 3) || '.' || (user_id % 250) END AS src_ip,
    '198.51.100.' || k AS dst_ip, 20000 + event_id % 40000 AS src_port, {_list(PORTS)}[k % 8 + 1] AS dst_port,
    CASE WHEN event_id % 4 = 3 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CASE WHEN {_TLS} THEN {_D}[k % 12 + 1] ELSE '' END AS sni,
    CASE WHEN event_type IN ('error', 'view') THEN {_D}[(k + 5) % 12 + 1] ELSE '' END AS dns_domain,
    1 + k % 9 AS packets_up, 1 + k % 23 AS packets_down, bu AS bytes_up, bu * (k % 7) AS bytes_down, k * 400 AS duration_ms,
    {_list(MACS)}[user_id % 6 + 1] || ':00:' || lpad(CAST(user_id // 100 % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS src_mac,
    CASE WHEN {_TLS} THEN sha256(CAST(user_id % 5 AS VARCHAR)) ELSE '' END AS ja3,
    CASE WHEN {_TLS} THEN '771-' || (17 - user_id % 3) || '-10-29' ELSE '' END AS tls_signature_hash,
    CASE WHEN {_TLS} THEN 4865 + k % 3 ELSE 0 END AS server_cipher_suite,
    CASE WHEN {_TLS} THEN CASE WHEN k % 2 = 0 THEN 'TLSv1.2' ELSE 'TLSv1.1' END ELSE '' END AS tls_version, '' AS ja3s,
    k, bu + bu * (k % 7) AS bytes
  FROM e
)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


RULES = f"rules(ord, app_id, app_name, app_category, domain) AS (VALUES {_values(dimensions.rules())})"
SERVICES = f"services(port, app_id, app_name, app_category) AS (VALUES {_values((int(p), *r) for p, r in dimensions.ports().items())})"
VENDORS = f"vendors(prefix, vendor) AS (VALUES {_values((p, *r) for p, r in dimensions.manufacturers().items())})"

#: The manufacturer that names tell.
BY_NAME = """CASE WHEN lower(base.sni || ' ' || base.dns_domain) LIKE '%miui%' OR lower(base.sni || ' ' || base.dns_domain) LIKE '%micloud%' THEN 'Xiaomi' WHEN lower(base.sni) = 'apple.com' OR lower(base.sni) LIKE '%.apple.com' OR lower(base.dns_domain) = 'icloud.com' OR lower(base.dns_domain) LIKE '%.icloud.com' THEN 'Apple' WHEN lower(base.sni) LIKE '%huawei%' OR lower(base.dns_domain) LIKE '%hicloud%' THEN 'Huawei' WHEN lower(base.sni || ' ' || base.dns_domain) LIKE '%windowsupdate%' OR lower(base.sni || ' ' || base.dns_domain) LIKE '%wns.windows%' THEN 'Microsoft Windows' WHEN lower(base.sni || ' ' || base.dns_domain) LIKE '%samsung%' THEN 'Samsung' ELSE '' END"""

FLOWS = f"""WITH {BASE}, {RULES}, {SERVICES}, {VENDORS}, names AS (
  SELECT DISTINCT sni, dns_domain, lower(sni) AS s, lower(dns_domain) AS d FROM base
), matched AS (
  SELECT sni, dns_domain, min(ord) AS ord FROM names JOIN rules
    ON s = domain OR d = domain OR ends_with(s, '.' || domain) OR ends_with(d, '.' || domain) GROUP BY sni, dns_domain
), flows AS (
  SELECT base.*, CAST(coalesce(r.app_id, p.app_id, 0) AS BIGINT) AS app_id, coalesce(r.app_name, p.app_name, 'Unknown') AS app_name,
    coalesce(r.app_category, p.app_category, 'Unknown') AS app_category,
    CASE WHEN r.ord IS NOT NULL THEN 0.85 WHEN p.port IS NOT NULL THEN 0.6 ELSE 0.0 END AS confidence,
    coalesce(v.vendor, {BY_NAME}) AS device_manufacturer
  FROM base LEFT JOIN matched m ON base.sni = m.sni AND base.dns_domain = m.dns_domain LEFT JOIN rules r ON r.ord = m.ord
    LEFT JOIN services p ON p.port = base.dst_port LEFT JOIN vendors v ON v.prefix = substr(base.src_mac, 1, 8)
), now AS (SELECT max(timestamp) AS t FROM base)
"""
# a rule's domains have an ord each, so min(ord) is one row of rules


def since(days: int = 1, column: str = "timestamp") -> str:
    return f"{column} >= (SELECT t FROM now) - INTERVAL {days} DAY"


def before(days: int = 1) -> str:
    return f"timestamp < (SELECT t FROM now) - INTERVAL {days} DAY"
