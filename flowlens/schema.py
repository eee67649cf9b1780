"""The tables' schemas, as DDL. Flow strings are never null: '' stands for what is absent, and 0 for absent numbers."""

from __future__ import annotations

PACKETS = "seq long, timestamp_ns long, src_ip binary, dst_ip binary, src_port int, dst_port int, protocol short, payload binary, src_mac binary, snaplen int, tcp_flags short, tcp_seq long"

VERDICT = "struct<engine:string,app_id:bigint,app_name:string,app_category:string,confidence:float,detail:string>"

FLOWS = (
    "timestamp timestamp_ntz, first_seen long, last_seen long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "sni string, ja3 string, ja3s string, tls_version string, server_cipher_suite int, tls_signature_hash string, dns_domain string, "
    "http_host string, http_method string, http_ua string, packets_up long, packets_down long, bytes_up long, bytes_down long, duration_ms long, "
    "pkt_size_hist array<long>, pkt_iat_mean_us double, app_id long, app_name string, app_category string, confidence float, src_mac string, "
    f"device_manufacturer string, device_hostname string, engines array<{VERDICT}>, risk_score short"
)

ALERTS = "timestamp timestamp_ntz, src_ip string, src_mac string, risk_score short, reason string, details string, resolved short"
DEVICES = "ip string, mac string, hostname string, vendor_class string, manufacturer string, first_seen long"
HTTP_SESSIONS = "timestamp timestamp_ntz, host string, path string, method string, user_agent string, content_type string, scheme string, src_ip string, status_code int, content_length long, port int"
DAILY = "date date, app_id long, app_name string, app_category string, flow_count long, total_bytes long, unique_devices long"
GEO = "ip string, country string, country_code string, city string, lat double, lon double"
#: Records of the JSON source: every field may be missing.
UDP_JSON = (
    "type string, timestamp double, first_seen long, last_seen long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "tls_sni string, http_host string, dns_domain string, src_mac string, hostname string, packets long, bytes long, ip string, mac string, vendor_class string, "
    "host string, path string, method string, user_agent string, content_type string, scheme string, status_code int, content_length long, port int"
)
