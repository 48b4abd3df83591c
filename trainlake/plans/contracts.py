"""Column contracts of the staged tables.

Each line lists ``raw`` or ``raw:staged`` names under the type they are cast
to.  ``int``/``bigint`` round (see ``functions.casts``); ``asis`` keeps the type.
Columns computed from others live in ``plans.staging``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    raw: str
    staged: str
    kind: str


def contract(**blocks: str) -> tuple[Field, ...]:
    fields = []
    for kind, text in blocks.items():
        for token in text.split():
            raw, _, staged = token.partition(":")
            fields.append(Field(raw, staged or raw, {"integer": "int"}.get(kind, kind)))
    return tuple(fields)


# ---------------------------------------------------------------------------
# Raw names, staged names and types of the public tables.
# ---------------------------------------------------------------------------

ACTIVITY_LOG = contract(
    bigint="activity_id weather_observation_time sunrise_time sunset_time",
    integer="""
        elapsed_time:elapsed_time_s moving_time:moving_time_s
        average_heart_rate:average_heart_rate_bpm max_heart_rate:max_heart_rate_bpm
        average_cadence max_cadence power_count calories:calories_kcal
        perceived_exertion perceived_relative_effort total_steps number_of_runs total_cycles
        bike:bike_id weather_condition wind_bearing:wind_bearing_deg precipitation_type flagged
        training_load:strava_training_load intensity:strava_intensity recovery:strava_recovery
    """,
    double="""
        distance:distance_m average_speed:average_speed_ms max_speed:max_speed_ms
        grade_adjusted_distance:grade_adjusted_distance_m
        elevation_gain:elevation_gain_m elevation_loss:elevation_loss_m
        elevation_low:elevation_low_m elevation_high:elevation_high_m
        max_grade:max_grade_pct average_grade:average_grade_pct average_grade_adjusted_pace
        average_watts weighted_average_power:weighted_average_power_w total_work:total_work_kj
        relative_effort average_temperature:average_temperature_c
        athlete_weight:athlete_weight_kg bike_weight:bike_weight_kg
        weather_temperature:weather_temperature_c apparent_temperature:apparent_temperature_c
        dewpoint:dewpoint_c humidity:humidity_fraction weather_pressure:weather_pressure_hpa
        wind_speed:wind_speed_ms wind_gust:wind_gust_ms
        precipitation_intensity precipitation_probability cloud_cover:cloud_cover_fraction
        weather_visibility:weather_visibility_m uv_index weather_ozone:weather_ozone_du moon_phase
        total_grit average_flow dirt_distance:dirt_distance_m
        average_elapsed_speed:average_elapsed_speed_ms
    """,
    boolean="from_upload prefer_perceived_exertion commute",
    date="activity_date",
    timestamp="started_at",
    asis="activity_name activity_type activity_description activity_gear filename media",
)

DEVICE_ACTIVITIES = contract(
    bigint="activity_id device_id",
    integer="""
        user_profile_id time_zone_id difference_body_battery:body_battery_change lap_count
        moderate_intensity_minutes:moderate_intensity_min_week_to_date
        vigorous_intensity_minutes:vigorous_intensity_min_week_to_date
    """,
    double="""
        distance:distance_m avg_speed:avg_speed_ms max_speed:max_speed_ms
        avg_hr:avg_hr_bpm max_hr:max_hr_bpm min_hr:min_hr_bpm
        calories:calories_kcal bmr_calories:bmr_calories_kcal
        elevation_gain:elevation_gain_raw elevation_loss:elevation_loss_raw
        min_elevation:min_elevation_raw max_elevation:max_elevation_raw
        max_vertical_speed:max_vertical_speed_ms
        aerobic_training_effect anaerobic_training_effect activity_training_load
        avg_power:avg_power_w norm_power:norm_power_w
        avg_fractional_cadence:avg_cadence_half_rpm max_fractional_cadence:max_cadence_half_rpm
        avg_run_cadence:avg_run_cadence_spm
        start_latitude start_longitude end_latitude end_longitude water_estimated:water_estimated_ml
    """,
    boolean="pr:is_pr favorite:is_favorite elevation_corrected parent:is_multisport_parent",
    asis="name:activity_name activity_type sport_type training_effect_label location_name manufacturer",
)

DAILY_SUMMARY = contract(
    integer="""
        user_profile_pk total_steps daily_step_goal
        total_distance_meters:total_distance_m wellness_distance_meters:wellness_distance_m
        net_calorie_goal highly_active_seconds:highly_active_s active_seconds:active_s
        moderate_intensity_minutes:moderate_intensity_min_week_to_date
        vigorous_intensity_minutes:vigorous_intensity_min_week_to_date
        user_intensity_minutes_goal:intensity_minutes_weekly_goal user_floors_ascended_goal:floors_goal
        min_heart_rate:min_hr_bpm max_heart_rate:max_hr_bpm resting_heart_rate:resting_hr_bpm
        current_day_resting_heart_rate:current_resting_hr_bpm
        min_avg_heart_rate:min_5min_avg_hr_bpm max_avg_heart_rate:max_5min_avg_hr_bpm
        stress_avg_total:stress_avg stress_max_total:stress_max
        stress_duration_total_s:stress_duration_s stress_rest_duration_total_s:stress_rest_duration_s
        stress_avg_awake body_battery_charged body_battery_drained body_battery_highest
        body_battery_lowest body_battery_start_of_day body_battery_end_of_day
        body_battery_sleep_start body_battery_sleep_end
        body_battery_during_sleep:body_battery_gained_during_sleep
    """,
    double="""
        total_kilocalories:total_kcal active_kilocalories:active_kcal bmr_kilocalories:bmr_kcal
        remaining_kilocalories:remaining_kcal
        floors_ascended_in_meters:floors_ascended_m floors_descended_in_meters:floors_descended_m
        average_monitoring_environment_altitude:avg_altitude_m
        avg_waking_respiration:avg_waking_respiration_brpm highest_respiration:highest_respiration_brpm
        lowest_respiration:lowest_respiration_brpm latest_respiration:latest_respiration_brpm
        hydration_value_ml:hydration_logged_ml hydration_goal_ml hydration_sweat_loss_ml
        hydration_adjusted_goal_ml
    """,
    boolean="is_vigorous_day includes_wellness_data includes_activity_data includes_calorie_consumed_data",
    date="calendar_date",
    timestamp="""
        wellness_start_time_gmt:wellness_start_utc wellness_end_time_gmt:wellness_end_utc
        wellness_start_time_local:wellness_start_local wellness_end_time_local:wellness_end_local
        latest_respiration_time_gmt:latest_respiration_at_utc
    """,
    asis="uuid",
)

SLEEP = contract(
    integer="""
        deep_sleep_seconds:deep_sleep_s light_sleep_seconds:light_sleep_s rem_sleep_seconds:rem_sleep_s
        awake_sleep_seconds:awake_s unmeasurable_seconds:unmeasurable_s
        awake_count restless_moment_count
        sleep_score_overall:sleep_score sleep_score_quality sleep_score_duration sleep_score_recovery
        sleep_score_deep sleep_score_rem sleep_score_light
        sleep_score_awakenings_count:sleep_score_awakenings sleep_score_awake_time
        sleep_score_combined_awake sleep_score_restfulness sleep_score_interruptions
    """,
    double="""
        avg_sleep_stress average_respiration:avg_respiration_brpm
        lowest_respiration:lowest_respiration_brpm highest_respiration:highest_respiration_brpm
    """,
    boolean="retro",
    date="calendar_date",
    timestamp="sleep_start_timestamp_gmt:sleep_start_utc sleep_end_timestamp_gmt:sleep_end_utc",
    asis="sleep_window_confirmation_type sleep_score_feedback sleep_score_insight",
)

TRAINING_READINESS = contract(
    bigint="device_id",
    integer="""
        user_profile_pk score:readiness_score recovery_time:recovery_time_h
        recovery_time_factor_percent:recovery_time_factor_pct hrv_factor_percent:hrv_factor_pct
        sleep_history_factor_percent:sleep_history_factor_pct
        sleep_score_factor_percent:sleep_score_factor_pct
        acwr_factor_percent:acwr_factor_pct acute_load
        stress_history_factor_percent:stress_history_factor_pct
    """,
    double="hrv_weekly_average:hrv_weekly_avg_ms",
    boolean="valid_sleep",
    date="calendar_date",
    timestamp="timestamp:assessed_at_utc timestamp_local:assessed_at_local",
    asis="""
        level:readiness_level feedback_short feedback_long input_context
        recovery_time_factor_feedback hrv_factor_feedback sleep_history_factor_feedback
        sleep_score_factor_feedback acwr_factor_feedback stress_history_factor_feedback
    """,
)

TRAINING_LOAD = contract(
    bigint="device_id",
    integer="""
        user_profile_pk daily_training_load_acute:acute_load_7d
        daily_training_load_chronic:chronic_load_28d acwr_percent:acwr_pct
    """,
    double="daily_acute_chronic_workload_ratio:acwr",
    asis="acwr_status acwr_status_feedback",
)

TRAINING_STATUS = contract(
    bigint="device_id",
    integer="user_profile_pk",
    date="calendar_date",
    timestamp="timestamp:assessed_at_utc",
    asis="training_status fitness_level_trend training_status2_feedback_phrase:feedback_phrase",
)

VO2MAX = contract(
    bigint="device_id",
    integer="user_profile_pk",
    double="vo2_max_value:vo2max_ml_kg_min max_met",
    boolean="calibrated_data:is_calibrated",
    date="calendar_date",
    timestamp="update_timestamp:updated_at_utc",
    asis="sport sub_sport max_met_category",
)

ENDURANCE_SCORE = contract(
    bigint="device_id",
    integer="""
        user_profile_pk overall_score:endurance_score classification:classification_id
        feedback_phrase:feedback_phrase_id
    """,
    double="""
        cycling_contribution:cycling_contribution_pct running_contribution:running_contribution_pct
        hiking_walking_contribution:hiking_walking_contribution_pct
        other_aerobic_contribution:other_aerobic_contribution_pct
    """,
    boolean="primary_training_device:is_primary_device",
)

HILL_SCORE = contract(
    bigint="device_id",
    integer="""
        user_profile_pk overall_score:hill_score strength_score:hill_score_strength
        endurance_score:hill_score_endurance hill_score_classification_id:classification_id
        hill_score_feedback_phrase_id:feedback_phrase_id
    """,
    boolean="primary_training_device:is_primary_device",
)

RACE_PREDICTIONS = contract(
    bigint="device_id",
    integer="""
        user_profile_pk race_time5_k:predicted_5k_s race_time10_k:predicted_10k_s
        race_time_half:predicted_half_s race_time_marathon:predicted_marathon_s
    """,
    date="calendar_date",
    timestamp="timestamp:updated_at_utc",
)

# Metric types of the long health table and the fields taken from each.
# ``field:alias`` per metric; ``hi``/``lo`` are the baseline limits.
HEALTH_METRICS = {
    "HRV": "value:hrv_ms hi:hrv_baseline_upper_ms lo:hrv_baseline_lower_ms status:hrv_status percentage:hrv_pct_in_range",
    "HR": """value:resting_hr_bpm hi:resting_hr_baseline_upper lo:resting_hr_baseline_lower
             status:resting_hr_status percentage:resting_hr_pct_in_range""",
    "SKIN_TEMP_C": """value:skin_temp_delta_c hi:skin_temp_baseline_upper lo:skin_temp_baseline_lower
                      status:skin_temp_status""",
    "RESPIRATION": """value:respiration_brpm hi:respiration_baseline_upper lo:respiration_baseline_lower
                      status:respiration_status""",
}

# Columns the day spine takes from each source, ``column`` or ``column:name``.
DAY_SPINE = {
    "daily_summary": """
        user_profile_pk total_steps daily_step_goal total_distance_m total_kcal active_kcal bmr_kcal
        highly_active_s active_s moderate_intensity_min_week_to_date vigorous_intensity_min_week_to_date
        is_vigorous_day min_hr_bpm max_hr_bpm resting_hr_bpm:resting_hr_7d_avg_bpm current_resting_hr_bpm
        stress_avg stress_max stress_avg_awake stress_duration_s
        body_battery_charged body_battery_drained body_battery_highest body_battery_lowest
        body_battery_start_of_day body_battery_end_of_day body_battery_sleep_start body_battery_sleep_end
        body_battery_gained_during_sleep avg_waking_respiration_brpm avg_altitude_m floors_ascended_m
    """,
    "sleep": """
        sleep_start_utc sleep_end_utc sleep_window_confirmation_type total_sleep_s deep_sleep_s
        light_sleep_s rem_sleep_s awake_s:sleep_awake_s awake_count avg_sleep_stress
        restless_moment_count avg_respiration_brpm:sleep_avg_respiration_brpm
        sleep_score sleep_score_quality sleep_score_duration sleep_score_recovery sleep_score_deep
        sleep_score_rem sleep_score_restfulness sleep_score_feedback
    """,
    "training_load": "acute_load_7d chronic_load_28d acwr acwr_pct acwr_status acwr_status_feedback",
    "training_status": "training_status fitness_level_trend feedback_phrase:training_status_feedback",
    "training_readiness": """
        readiness_score readiness_level feedback_short:readiness_feedback_short
        feedback_long:readiness_feedback_long hrv_weekly_avg_ms:readiness_hrv_weekly_avg_ms
        hrv_factor_pct hrv_factor_feedback sleep_score_factor_pct sleep_score_factor_feedback
        sleep_history_factor_pct sleep_history_factor_feedback recovery_time_h
        recovery_time_factor_pct recovery_time_factor_feedback acute_load:readiness_acute_load
        acwr_factor_pct acwr_factor_feedback stress_history_factor_pct stress_history_factor_feedback
        valid_sleep input_context:readiness_input_context assessed_at_local:readiness_assessed_at_local
    """,
    "health_status": """
        hrv_ms hrv_baseline_lower_ms hrv_baseline_upper_ms hrv_status hrv_pct_in_range
        resting_hr_bpm:health_status_resting_hr_bpm resting_hr_baseline_lower resting_hr_baseline_upper
        resting_hr_status resting_hr_pct_in_range skin_temp_delta_c skin_temp_status
        respiration_brpm:health_status_respiration_brpm respiration_status
        is_onboarding:health_status_is_onboarding
    """,
}

# Activity-log columns kept by the activity mart.
ACTIVITY_COLUMNS = """
    activity_id activity_date started_at activity_name activity_type from_upload
    distance_m elapsed_time_s moving_time_s average_speed_ms max_speed_ms
    elevation_gain_m elevation_loss_m elevation_low_m elevation_high_m max_grade_pct average_grade_pct
    grade_adjusted_distance_m average_grade_adjusted_pace average_heart_rate_bpm max_heart_rate_bpm
    average_watts weighted_average_power_w total_work_kj power_count average_cadence max_cadence
    calories_kcal relative_effort perceived_exertion perceived_relative_effort total_steps
    average_temperature_c weather_temperature_c apparent_temperature_c dewpoint_c humidity_fraction
    wind_speed_ms wind_gust_ms wind_bearing_deg weather_pressure_hpa
    precipitation_intensity precipitation_probability cloud_cover_fraction uv_index
    activity_gear commute athlete_weight_kg bike_weight_kg
"""

# Device-recording columns attached by the match, ``column`` or ``column:name``.
MATCHED_COLUMNS = """
    avg_power_w:garmin_avg_power_w norm_power_w:garmin_norm_power_w
    aerobic_training_effect anaerobic_training_effect training_effect_label activity_training_load
    body_battery_change:activity_body_battery_change is_pr
    hr_zone_0_s hr_zone_1_s hr_zone_2_s hr_zone_3_s hr_zone_4_s hr_zone_5_s hr_zone_6_s
"""

# Day-spine columns attached to each activity.
DAY_CONTEXT_COLUMNS = """
    readiness_score readiness_level readiness_feedback_short hrv_factor_pct hrv_factor_feedback
    readiness_hrv_weekly_avg_ms sleep_score_factor_pct sleep_score_factor_feedback
    sleep_history_factor_pct sleep_history_factor_feedback recovery_time_h recovery_time_factor_pct
    recovery_time_factor_feedback acwr_factor_pct acwr_factor_feedback readiness_acute_load
    stress_history_factor_pct stress_history_factor_feedback valid_sleep
    sleep_score total_sleep_s deep_sleep_s rem_sleep_s light_sleep_s sleep_awake_s avg_sleep_stress
    body_battery_start_of_day body_battery_highest stress_avg stress_avg_awake
    hrv_ms hrv_status health_status_resting_hr_bpm
    acute_load_7d chronic_load_28d acwr acwr_status training_status fitness_level_trend
"""

# Columns of the activity mart that the sport marts leave out.
SPORT_DROPS = """
    perceived_relative_effort power_count average_grade_adjusted_pace dewpoint_c weather_pressure_hpa
    precipitation_probability sleep_score_factor_feedback sleep_history_factor_feedback
    recovery_time_factor_feedback acwr_factor_feedback stress_history_factor_feedback sleep_awake_s
"""
RIDE_DROPS = SPORT_DROPS + " grade_adjusted_distance_m total_steps"
RUN_DROPS = SPORT_DROPS + """
    activity_gear commute bike_weight_kg average_speed_ms max_speed_ms max_cadence average_watts
    weighted_average_power_w total_work_kj garmin_avg_power_w garmin_norm_power_w
    wind_bearing_deg uv_index
"""

# Activity types of the sport marts.
RIDE_TYPES = ("Ride", "VirtualRide", "MountainBikeRide", "GravelRide")
RUN_TYPES = ("Run", "TrailRun")

# Activity-log types and the device types they may match, per family.
TYPE_FAMILIES = {
    "ride": (
        RIDE_TYPES,
        (
            "road_biking", "cycling", "virtual_ride", "mountain_biking", "gravel_cycling",
            "indoor_cycling", "downhill_biking",
        ),
    ),
    "run": (RUN_TYPES, ("running", "trail_running", "treadmill_running", "indoor_running")),
    "walk": (("Walk", "Hike"), ("walking", "hiking")),
    "strength": (("Weight Training", "Crossfit"), ("strength_training",)),
    "ski": (
        ("Alpine Ski", "Backcountry Ski", "NordicSki"),
        (
            "resort_skiing", "resort_skiing_snowboarding_ws", "backcountry_skiing",
            "backcountry_skiing_snowboarding_ws", "cross_country_skiing", "winter_sports",
        ),
    ),
    "cardio": (("Elliptical", "Workout"), ("elliptical", "indoor_cardio")),
    "yoga": (("Yoga",), ("yoga",)),
    "swim": (("Swim", "OpenWaterSwim"), ("swimming", "open_water_swimming")),
    "paddle": (("Kayaking", "Canoe"), ("whitewater_rafting_kayaking",)),
    "golf": (("Golf",), ("golf",)),
}


def pairs(text: str) -> dict[str, str]:
    """``"a b:c"`` -> ``{"a": "a", "b": "c"}``."""
    return {raw: name or raw for raw, _, name in (t.partition(":") for t in text.split())}
