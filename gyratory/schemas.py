"""Explicit schemas of the file formats."""

LABELS = """
responseId STRING, view_label STRING, videos STRING, video_time TIMESTAMP, datetimestamp_start TIMESTAMP,
datetimestamp_end TIMESTAMP, date DATE, congestion_enter_rating STRING, congestion_exit_rating STRING,
signaling STRING, time_segment_id INT, cycle_phase STRING, ID_enter STRING, ID_exit STRING
"""

TRACKING = """
video_name STRING, total_vehicles_detected INT, zones ARRAY<STRING>, valid_patterns ARRAY<STRING>,
vehicles ARRAY<STRUCT<tracker_id BIGINT, class_id INT, class_name STRING, first_seen_frame INT, last_seen_frame INT,
  first_seen_time DOUBLE, last_seen_time DOUBLE,
  events ARRAY<STRUCT<event_type STRING, zone_name STRING, frame INT, timestamp DOUBLE>>,
  validations ARRAY<STRUCT<pattern STRING, start_zone STRING, end_zone STRING, is_valid BOOLEAN,
    journey_times STRUCT<t1_enter_start_zone DOUBLE, t2_exit_start_zone DOUBLE, t3_enter_end_zone DOUBLE,
      t4_exit_end_zone DOUBLE, journey_type STRING, time_in_start_zone DOUBLE, time_between_zones DOUBLE,
      time_in_end_zone DOUBLE, total_journey_time DOUBLE, distance_meters DOUBLE, speed_m_s DOUBLE, speed_km_h DOUBLE>>>,
  has_valid_journey BOOLEAN>>,
valid_journeys_count INT, validation_rate DOUBLE
"""

ZONE_CONFIG = "zones MAP<STRING, ARRAY<ARRAY<DOUBLE>>>"

SUBMISSION = "ID STRING, Target STRING, Target_Accuracy STRING"

DETECTIONS = """
camera_id INT, video_name STRING, tracker_id BIGINT, frame_num INT, timestamp_s DOUBLE, class_id INT, class_name STRING,
x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE
"""
