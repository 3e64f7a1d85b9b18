"""Shared SQL of the oracles: the packet table as common table expressions."""

PACKETS = """
WITH base AS (
  SELECT event_id, event_id + 1 AS packet_id, 1704067200000000 + event_id * 250000 AS timestamp_us, user_id AS c,
    (user_id * 7 + CAST(floor(event_id / 1600) AS BIGINT)) % 12 AS s, event_id % 3 = 0 AS rev, 40 + (event_id * 37) % 1400 AS payload_len
  FROM events
), named AS (
  SELECT *, '10.0.' || CAST(CAST(floor(c / 50) AS BIGINT) AS VARCHAR) || '.' || CAST(1 + c % 50 AS VARCHAR) AS client_ip, 40000 + c AS client_port,
    '192.168.1.' || CAST(10 + s AS VARCHAR) AS server_ip,
    CASE s % 8 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 445 WHEN 4 THEN 5353 WHEN 5 THEN 67 WHEN 6 THEN 21 ELSE 389 END AS server_port
  FROM base
), packets AS (
  SELECT packet_id, timestamp_us, c, payload_len, client_ip AS ip1, CAST(client_port AS BIGINT) AS port1, server_ip AS ip2, CAST(server_port AS BIGINT) AS port2,
    CASE WHEN rev THEN server_ip ELSE client_ip END AS src_ip, CAST(CASE WHEN rev THEN server_port ELSE client_port END AS BIGINT) AS src_port,
    CASE WHEN rev THEN client_ip ELSE server_ip END AS dst_ip, CAST(CASE WHEN rev THEN client_port ELSE server_port END AS BIGINT) AS dst_port,
    CASE WHEN server_port IN (53, 67, 5353) THEN 'UDP' ELSE 'TCP' END AS protocol,
    payload_len + CASE WHEN server_port IN (53, 67, 5353) THEN 42 ELSE 54 END AS packet_size,
    '02:00:00:00:' || lower(lpad(hex(CAST(floor(c / 256) AS INTEGER)), 2, '0')) || ':' || lower(lpad(hex(CAST(c % 256 AS INTEGER)), 2, '0')) AS src_mac
  FROM named
)"""

GAP = PACKETS + """, gaps AS (
  SELECT *, CASE WHEN timestamp_us - lag(timestamp_us) OVER (PARTITION BY ip1, port1, ip2, port2 ORDER BY packet_id) >= 120000000 THEN 1 ELSE 0 END AS brk FROM packets
), sessions AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY ip1, port1, ip2, port2 ORDER BY packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM gaps
)"""

SWEEP = PACKETS + """, sweeps AS (SELECT packet_id AS sweep, timestamp_us AS at FROM packets WHERE packet_id % 256 = 0
), gaps AS (
  SELECT p.*, CASE WHEN w.sweep > lag(p.packet_id) OVER k AND w.at - lag(p.timestamp_us) OVER k >= 120000000 THEN 1 ELSE 0 END AS brk
  FROM packets p LEFT JOIN sweeps w ON w.sweep = CAST(floor((p.packet_id - 1) / 256) AS BIGINT) * 256
  WINDOW k AS (PARTITION BY ip1, port1, ip2, port2 ORDER BY p.packet_id)
), sessions AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY ip1, port1, ip2, port2 ORDER BY packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM gaps
)"""

SUMMARY = """, firsts AS (SELECT *, first_value(src_ip) OVER w AS first_ip, first_value(src_port) OVER w AS first_port, first_value(protocol) OVER w AS first_protocol
  FROM sessions WINDOW w AS (PARTITION BY ip1, port1, ip2, port2, session_id ORDER BY packet_id))
SELECT ip1, port1, ip2, port2, session_id, any_value(first_ip) AS src_ip, any_value(first_protocol) AS protocol, count(*) AS packets,
  CAST(sum(CASE WHEN src_ip = first_ip AND src_port = first_port THEN payload_len ELSE 0 END) AS BIGINT) AS bytes_sent,
  CAST(sum(CASE WHEN src_ip = first_ip AND src_port = first_port THEN 0 ELSE payload_len END) AS BIGINT) AS bytes_received,
  min(timestamp_us) AS first_seen_us, max(timestamp_us) AS last_seen_us
FROM firsts GROUP BY ip1, port1, ip2, port2, session_id"""

RUNNING = """, firsts AS (SELECT *, first_value(src_ip) OVER w AS first_ip, first_value(src_port) OVER w AS first_port
  FROM sessions WINDOW w AS (PARTITION BY ip1, port1, ip2, port2, session_id ORDER BY packet_id))
SELECT packet_id, session_id, row_number() OVER r = 1 AS is_new, count(*) OVER r AS flow_packets,
  CAST(sum(CASE WHEN src_ip = first_ip AND src_port = first_port THEN payload_len ELSE 0 END) OVER r AS BIGINT) AS flow_tx_bytes,
  CAST(sum(CASE WHEN src_ip = first_ip AND src_port = first_port THEN 0 ELSE payload_len END) OVER r AS BIGINT) AS flow_rx_bytes
FROM firsts WINDOW r AS (PARTITION BY ip1, port1, ip2, port2, session_id ORDER BY packet_id ROWS UNBOUNDED PRECEDING)"""
