"""Message views derived from the ``events`` table.

The SQL text is portable: Spark and DuckDB run it unchanged, so the same view
feeds both sides of an oracle comparison. ``events`` is the only input; every
row of it becomes a message, so the views grow with the data.
"""

TELEMETRY_LONG = """
SELECT event_id * 10 + CASE WHEN event_id % 10 = 0 THEN 5001 ELSE 0 END AS arrival_seq,
       'DEV-' || lpad(CAST(user_id AS STRING), 4, '0') AS device_id,
       date_trunc('day', ts) AS time,
       ts AS event_ts,
       CASE event_type WHEN 'click' THEN 'temperature' WHEN 'error' THEN 'humidity'
            WHEN 'purchase' THEN 'pressure' WHEN 'signup' THEN 'gas_resistance'
            ELSE 'accel_x' END AS field,
       value
FROM events
"""

RAW_MESSAGES = """
WITH e AS (
  SELECT event_id,
         ts,
         'DEV-' || lpad(CAST(user_id AS STRING), 4, '0') AS did,
         substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || 'Z' AS iso,
         CASE event_type WHEN 'click' THEN 'temperature' WHEN 'error' THEN 'humidity'
              WHEN 'purchase' THEN 'pressure' WHEN 'signup' THEN 'gas_resistance'
              ELSE 'accel_x' END AS field,
         CAST(value AS STRING) AS v
  FROM events)
SELECT event_id * 10 + CASE WHEN event_id % 10 = 0 THEN 5001 ELSE 0 END AS arrival_seq,
       ts AS arrival_ts,
       CASE WHEN event_id % 101 = 0 THEN 'lonely' WHEN event_id % 103 = 0 THEN 'sensors/OTHER/telemetry'
            ELSE 'sensors/' || did || CASE WHEN event_id % 23 = 0 THEN '/status'
                                           WHEN event_id % 29 = 0 THEN '/diagnostics'
                                           ELSE '/telemetry' END END AS topic,
       CASE WHEN event_id % 41 = 0 THEN 'not json'
            WHEN event_id % 43 = 0 THEN '[1,2]'
            WHEN event_id % 47 = 0 THEN '{"timestamp":"' || iso || '","' || field || '":' || v || '}'
            WHEN event_id % 51 = 0 THEN '{"device_id":"","timestamp":"' || iso || '","' || field || '":' || v || '}'
            WHEN event_id % 53 = 0 THEN '{"device_id":"' || did || '","' || field || '":' || v || '}'
            WHEN event_id % 59 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":"abc"}'
            WHEN event_id % 61 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":"' || v || '"}'
            WHEN event_id % 67 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":true}'
            WHEN event_id % 71 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":' || v || ',"firmware":"1.0.0","location":"lab","x":1}'
            WHEN event_id % 73 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":null}'
            WHEN event_id % 79 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":"' || v || 'd"}'
            WHEN event_id % 83 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":"0x1p3"}'
            WHEN event_id % 89 = 0 THEN '{"device_id":"' || did || '","timestamp":"2024-13-45T00:00:00Z","' || field || '":' || v || '}'
            WHEN event_id % 5 = 1 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":' || v || '5}'
            ELSE '{"device_id":"' || did || '","timestamp":"' || iso || '","' || field || '":' || v || '}'
       END AS payload
FROM e
"""

# Several payload times of a sensor collide, so that the last write has to win.
# arrival_ts is the hub's wall clock (the event time of the row); the payload
# clock is 2024-01-01T00:00Z plus one minute for each of 50 slots.
LEGACY_MESSAGES = """
WITH e AS (
  SELECT event_id,
         ts,
         'DEV-' || lpad(CAST(user_id AS STRING), 4, '0') AS did,
         CAST(1704067200000 + event_id % 50 * 60000 AS STRING) AS ms,
         CAST(value AS STRING) AS v,
         CAST(event_id % 1000 AS STRING) AS n
  FROM events)
SELECT event_id AS arrival_seq,
       ts AS arrival_ts,
       CASE WHEN event_id % 97 = 0 THEN 'other/hub1/' || did || '/measurement'
            WHEN event_id % 37 = 0 THEN 'ws/hub1/' || did || '/registerMe'
            WHEN event_id % 31 = 0 THEN 'ws/hub1/' || did || '/a/b'
            WHEN event_id % 4 = 0 THEN 'ws/hub1/' || did || '/diag'
            ELSE 'ws/hub1/' || did || '/measurement' END AS topic,
       CASE WHEN event_id % 37 = 0 THEN ' hello '
            WHEN event_id % 19 = 0 THEN '{"t":' || v || '}'
            WHEN event_id % 4 = 0 THEN '{"ts":' || ms || ',"V":4.1,"rssi":-' || n || ',"fw":"v2"}'
            WHEN event_id % 17 = 0 THEN '{"ts":' || ms || ',"t":' || v || ',"p":"3.7"}'
            WHEN event_id % 13 = 0 THEN '{"ts":' || ms || ',"t":"' || v || '","voc":' || n || '}'
            ELSE '{"ts":' || ms || ',"t":' || v || ',"h":' || n || ',"p":' || n || '}' END AS payload
FROM e
"""

# Status and diagnostics messages of the documented contract (extensions X1,
# X2), with an invalid state, a missing timestamp and a missing device.
STATUS_MESSAGES = """
WITH e AS (
  SELECT event_id,
         ts,
         event_type,
         'DEV-' || lpad(CAST(user_id AS STRING), 4, '0') AS did,
         substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || 'Z' AS iso,
         CAST(value AS STRING) AS v
  FROM events)
SELECT event_id * 10 + CASE WHEN event_id % 10 = 0 THEN 5001 ELSE 0 END AS arrival_seq,
       ts AS arrival_ts,
       'sensors/' || did || CASE WHEN event_id % 2 = 0 THEN '/status' ELSE '/diagnostics' END AS topic,
       CASE WHEN event_id % 2 = 0 THEN
              CASE WHEN event_id % 13 = 0 THEN '{"device_id":"' || did || '","timestamp":"' || iso || '","state":"sleeping"}'
                   WHEN event_id % 17 = 0 THEN '{"device_id":"' || did || '","state":"online"}'
                   ELSE '{"device_id":"' || did || '","timestamp":"' || iso || '","state":"'
                        || CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'booting'
                                           WHEN 'view' THEN 'offline' ELSE 'online' END
                        || '","firmware_version":"1.' || CAST(event_id % 7 AS STRING) || '.0","uptime_s":'
                        || CAST(event_id AS STRING) || '}'
              END
            ELSE
              CASE WHEN event_id % 19 = 0 THEN '{"timestamp":"' || iso || '","battery_v":' || v || '}'
                   ELSE '{"device_id":"' || did || '","timestamp":"' || iso || '","battery_v":' || v
                        || ',"rssi_dbm":-' || CAST(event_id % 90 AS STRING) || ',"free_heap":'
                        || CAST(event_id * 3 AS STRING) || '}'
              END
       END AS payload
FROM e
"""

# Subscriptions of the consumers of those messages: one per device, of five
# forms, and some for all devices. Three are no valid filters, one is for the
# system space.
SUBSCRIPTIONS = """
WITH d AS (SELECT DISTINCT user_id AS u, 'DEV-' || lpad(CAST(user_id AS STRING), 4, '0') AS did FROM events)
SELECT 'device-' || CAST(u AS STRING) AS subscription_id,
       CASE u % 5 WHEN 0 THEN 'sensors/' || did || '/+' WHEN 1 THEN 'sensors/' || did || '/#'
                  WHEN 2 THEN '+/' || did || '/telemetry' WHEN 3 THEN 'sensors/' || did || '/status'
                  ELSE '+/' || did || '/#' END AS filter
FROM d
UNION ALL SELECT 'all', '#' FROM d WHERE u = (SELECT min(u) FROM d)
UNION ALL SELECT 'pair-' || CAST(u % 3 AS STRING), 'sensors/+/diagnostics' FROM d
UNION ALL SELECT 'other', 'sensors/OTHER/#' FROM d WHERE u % 7 = 0
UNION ALL SELECT 'one-level', '+' FROM d WHERE u % 11 = 0
UNION ALL SELECT 'below-lonely', 'lonely/#' FROM d WHERE u % 11 = 1
UNION ALL SELECT 'system', '$SYS/#' FROM d WHERE u % 11 = 2
UNION ALL SELECT 'invalid-' || CAST(u % 3 AS STRING),
                 CASE u % 3 WHEN 0 THEN 'sensors/#/telemetry' WHEN 1 THEN 'sensors/DEV+/telemetry' END FROM d
"""

# Fixed query parameters, so that batch runs repeat exactly.
INGEST_TIME = "2024-02-01T00:00:00Z"
NOW = "2024-01-31T00:00:00Z"
ACTIVE_TIMEOUT_S = 86400
HISTORY_DEVICE = "DEV-0003"
HISTORY_FROM = "2024-01-02T00:00:00Z"
HISTORY_TO = "2024-01-20T00:00:00Z"
HISTORY_LIMIT = 10
ALARM_LEVELS = {"temperature": (60.0, 30.0), "humidity": (10.0, 25.0), "pressure": (100.0, 99.0)}  # (raise, clear); humidity guards against low values
