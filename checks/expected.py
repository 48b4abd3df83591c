"""Columns and types that each model must have, stated apart from the code that makes them."""

# Name and type, in order; the athlete key comes first.
EXPECTED = {
    "stg_strava__activities": """
        athlete_id:bigint activity_id:bigint weather_observation_time:bigint sunrise_time:bigint sunset_time:bigint
        elapsed_time_s:int moving_time_s:int average_heart_rate_bpm:int max_heart_rate_bpm:int average_cadence:int max_cadence:int
        power_count:int calories_kcal:int perceived_exertion:int perceived_relative_effort:int total_steps:int number_of_runs:int
        total_cycles:int bike_id:int weather_condition:int wind_bearing_deg:int precipitation_type:int flagged:int
        strava_training_load:int strava_intensity:int strava_recovery:int distance_m:double average_speed_ms:double
        max_speed_ms:double grade_adjusted_distance_m:double elevation_gain_m:double elevation_loss_m:double
        elevation_low_m:double elevation_high_m:double max_grade_pct:double average_grade_pct:double
        average_grade_adjusted_pace:double average_watts:double weighted_average_power_w:double total_work_kj:double
        relative_effort:double average_temperature_c:double athlete_weight_kg:double bike_weight_kg:double
        weather_temperature_c:double apparent_temperature_c:double dewpoint_c:double humidity_fraction:double
        weather_pressure_hpa:double wind_speed_ms:double wind_gust_ms:double precipitation_intensity:double
        precipitation_probability:double cloud_cover_fraction:double weather_visibility_m:double uv_index:double
        weather_ozone_du:double moon_phase:double total_grit:double average_flow:double dirt_distance_m:double
        average_elapsed_speed_ms:double from_upload:boolean prefer_perceived_exertion:boolean commute:boolean activity_date:date
        started_at:timestamp_ntz activity_name:string activity_type:string activity_description:string activity_gear:string
        filename:string media:string
    """,
    "stg_garmin__activities": """
        athlete_id:bigint activity_id:bigint device_id:bigint user_profile_id:int time_zone_id:int body_battery_change:int
        lap_count:int moderate_intensity_min_week_to_date:int vigorous_intensity_min_week_to_date:int distance_m:double
        avg_speed_ms:double max_speed_ms:double avg_hr_bpm:double max_hr_bpm:double min_hr_bpm:double calories_kcal:double
        bmr_calories_kcal:double elevation_gain_raw:double elevation_loss_raw:double min_elevation_raw:double
        max_elevation_raw:double max_vertical_speed_ms:double aerobic_training_effect:double anaerobic_training_effect:double
        activity_training_load:double avg_power_w:double norm_power_w:double avg_cadence_half_rpm:double
        max_cadence_half_rpm:double avg_run_cadence_spm:double start_latitude:double start_longitude:double end_latitude:double
        end_longitude:double water_estimated_ml:double is_pr:boolean is_favorite:boolean elevation_corrected:boolean
        is_multisport_parent:boolean activity_name:string activity_type:string sport_type:string training_effect_label:string
        location_name:string manufacturer:string started_at_utc:timestamp_ntz start_time_utc:timestamp_ntz
        start_time_local:timestamp_ntz utc_offset_h:double duration_s:double moving_duration_s:double elapsed_duration_s:double
        hr_zone_0_s:double hr_zone_1_s:double hr_zone_2_s:double hr_zone_3_s:double hr_zone_4_s:double hr_zone_5_s:double
        hr_zone_6_s:double
    """,
    "stg_garmin__daily_summary": """
        athlete_id:bigint user_profile_pk:int total_steps:int daily_step_goal:int total_distance_m:int wellness_distance_m:int
        net_calorie_goal:int highly_active_s:int active_s:int moderate_intensity_min_week_to_date:int
        vigorous_intensity_min_week_to_date:int intensity_minutes_weekly_goal:int floors_goal:int min_hr_bpm:int max_hr_bpm:int
        resting_hr_bpm:int current_resting_hr_bpm:int min_5min_avg_hr_bpm:int max_5min_avg_hr_bpm:int stress_avg:int
        stress_max:int stress_duration_s:int stress_rest_duration_s:int stress_avg_awake:int body_battery_charged:int
        body_battery_drained:int body_battery_highest:int body_battery_lowest:int body_battery_start_of_day:int
        body_battery_end_of_day:int body_battery_sleep_start:int body_battery_sleep_end:int body_battery_gained_during_sleep:int
        total_kcal:double active_kcal:double bmr_kcal:double remaining_kcal:double floors_ascended_m:double
        floors_descended_m:double avg_altitude_m:double avg_waking_respiration_brpm:double highest_respiration_brpm:double
        lowest_respiration_brpm:double latest_respiration_brpm:double hydration_logged_ml:double hydration_goal_ml:double
        hydration_sweat_loss_ml:double hydration_adjusted_goal_ml:double is_vigorous_day:boolean includes_wellness_data:boolean
        includes_activity_data:boolean includes_calorie_consumed_data:boolean calendar_date:date wellness_start_utc:timestamp_ntz
        wellness_end_utc:timestamp_ntz wellness_start_local:timestamp_ntz wellness_end_local:timestamp_ntz
        latest_respiration_at_utc:timestamp_ntz uuid:string resting_hr_measured_at:timestamp_ntz
    """,
    "stg_garmin__sleep": """
        athlete_id:bigint deep_sleep_s:int light_sleep_s:int rem_sleep_s:int awake_s:int unmeasurable_s:int awake_count:int
        restless_moment_count:int sleep_score:int sleep_score_quality:int sleep_score_duration:int sleep_score_recovery:int
        sleep_score_deep:int sleep_score_rem:int sleep_score_light:int sleep_score_awakenings:int sleep_score_awake_time:int
        sleep_score_combined_awake:int sleep_score_restfulness:int sleep_score_interruptions:int avg_sleep_stress:double
        avg_respiration_brpm:double lowest_respiration_brpm:double highest_respiration_brpm:double retro:boolean
        calendar_date:date sleep_start_utc:timestamp_ntz sleep_end_utc:timestamp_ntz sleep_window_confirmation_type:string
        sleep_score_feedback:string sleep_score_insight:string total_sleep_s:int
    """,
    "stg_garmin__health_status": """
        athlete_id:bigint calendar_date:date is_onboarding:boolean outliers_count:int created_at_utc:timestamp_ntz hrv_ms:double
        hrv_baseline_upper_ms:double hrv_baseline_lower_ms:double hrv_status:string hrv_pct_in_range:double resting_hr_bpm:double
        resting_hr_baseline_upper:double resting_hr_baseline_lower:double resting_hr_status:string resting_hr_pct_in_range:double
        skin_temp_delta_c:double skin_temp_baseline_upper:double skin_temp_baseline_lower:double skin_temp_status:string
        respiration_brpm:double respiration_baseline_upper:double respiration_baseline_lower:double respiration_status:string
    """,
    "stg_garmin__training_readiness": """
        athlete_id:bigint device_id:bigint user_profile_pk:int readiness_score:int recovery_time_h:int
        recovery_time_factor_pct:int hrv_factor_pct:int sleep_history_factor_pct:int sleep_score_factor_pct:int
        acwr_factor_pct:int acute_load:int stress_history_factor_pct:int hrv_weekly_avg_ms:double valid_sleep:boolean
        calendar_date:date assessed_at_utc:timestamp_ntz assessed_at_local:timestamp_ntz readiness_level:string
        feedback_short:string feedback_long:string input_context:string recovery_time_factor_feedback:string
        hrv_factor_feedback:string sleep_history_factor_feedback:string sleep_score_factor_feedback:string
        acwr_factor_feedback:string stress_history_factor_feedback:string
    """,
    "stg_garmin__training_load": """
        athlete_id:bigint calendar_date:date device_id:bigint user_profile_pk:int acute_load_7d:int chronic_load_28d:int
        acwr_pct:int acwr:double acwr_status:string acwr_status_feedback:string assessed_at_utc:timestamp_ntz
    """,
    "stg_garmin__training_status": """
        athlete_id:bigint device_id:bigint user_profile_pk:int calendar_date:date assessed_at_utc:timestamp_ntz
        training_status:string fitness_level_trend:string feedback_phrase:string
    """,
    "stg_garmin__vo2max": """
        athlete_id:bigint device_id:bigint user_profile_pk:int vo2max_ml_kg_min:double max_met:double is_calibrated:boolean
        calendar_date:date updated_at_utc:timestamp_ntz sport:string sub_sport:string max_met_category:string
    """,
    "stg_garmin__endurance_score": """
        athlete_id:bigint calendar_date:date device_id:bigint user_profile_pk:int endurance_score:int classification_id:int
        feedback_phrase_id:int cycling_contribution_pct:double running_contribution_pct:double
        hiking_walking_contribution_pct:double other_aerobic_contribution_pct:double is_primary_device:boolean
        assessed_at_utc:timestamp_ntz
    """,
    "stg_garmin__hill_score": """
        athlete_id:bigint calendar_date:date device_id:bigint user_profile_pk:int hill_score:int hill_score_strength:int
        hill_score_endurance:int classification_id:int feedback_phrase_id:int is_primary_device:boolean
        assessed_at_utc:timestamp_ntz
    """,
    "stg_garmin__run_race_predictions": """
        athlete_id:bigint device_id:bigint user_profile_pk:int predicted_5k_s:int predicted_10k_s:int predicted_half_s:int
        predicted_marathon_s:int calendar_date:date updated_at_utc:timestamp_ntz predicted_5k_pace_min_per_km:double
        predicted_10k_pace_min_per_km:double predicted_half_pace_min_per_km:double predicted_marathon_pace_min_per_km:double
    """,
    "int_garmin__daily": """
        athlete_id:bigint calendar_date:date user_profile_pk:int total_steps:int daily_step_goal:int total_distance_m:int
        total_kcal:double active_kcal:double bmr_kcal:double highly_active_s:int active_s:int
        moderate_intensity_min_week_to_date:int vigorous_intensity_min_week_to_date:int is_vigorous_day:boolean min_hr_bpm:int
        max_hr_bpm:int resting_hr_7d_avg_bpm:int current_resting_hr_bpm:int stress_avg:int stress_max:int stress_avg_awake:int
        stress_duration_s:int body_battery_charged:int body_battery_drained:int body_battery_highest:int body_battery_lowest:int
        body_battery_start_of_day:int body_battery_end_of_day:int body_battery_sleep_start:int body_battery_sleep_end:int
        body_battery_gained_during_sleep:int avg_waking_respiration_brpm:double avg_altitude_m:double floors_ascended_m:double
        sleep_start_utc:timestamp_ntz sleep_end_utc:timestamp_ntz sleep_window_confirmation_type:string total_sleep_s:int
        deep_sleep_s:int light_sleep_s:int rem_sleep_s:int sleep_awake_s:int awake_count:int avg_sleep_stress:double
        restless_moment_count:int sleep_avg_respiration_brpm:double sleep_score:int sleep_score_quality:int
        sleep_score_duration:int sleep_score_recovery:int sleep_score_deep:int sleep_score_rem:int sleep_score_restfulness:int
        sleep_score_feedback:string acute_load_7d:int chronic_load_28d:int acwr:double acwr_pct:int acwr_status:string
        acwr_status_feedback:string training_status:string fitness_level_trend:string training_status_feedback:string
        readiness_score:int readiness_level:string readiness_feedback_short:string readiness_feedback_long:string
        readiness_hrv_weekly_avg_ms:double hrv_factor_pct:int hrv_factor_feedback:string sleep_score_factor_pct:int
        sleep_score_factor_feedback:string sleep_history_factor_pct:int sleep_history_factor_feedback:string recovery_time_h:int
        recovery_time_factor_pct:int recovery_time_factor_feedback:string readiness_acute_load:int acwr_factor_pct:int
        acwr_factor_feedback:string stress_history_factor_pct:int stress_history_factor_feedback:string valid_sleep:boolean
        readiness_input_context:string readiness_assessed_at_local:timestamp_ntz hrv_ms:double hrv_baseline_lower_ms:double
        hrv_baseline_upper_ms:double hrv_status:string hrv_pct_in_range:double health_status_resting_hr_bpm:double
        resting_hr_baseline_lower:double resting_hr_baseline_upper:double resting_hr_status:string resting_hr_pct_in_range:double
        skin_temp_delta_c:double skin_temp_status:string health_status_respiration_brpm:double respiration_status:string
        health_status_is_onboarding:boolean
    """,
    "fct_activity": """
        athlete_id:bigint activity_date:date activity_id:bigint started_at:timestamp_ntz activity_name:string activity_type:string
        from_upload:boolean distance_m:double elapsed_time_s:int moving_time_s:int average_speed_ms:double max_speed_ms:double
        elevation_gain_m:double elevation_loss_m:double elevation_low_m:double elevation_high_m:double max_grade_pct:double
        average_grade_pct:double grade_adjusted_distance_m:double average_grade_adjusted_pace:double average_heart_rate_bpm:int
        max_heart_rate_bpm:int average_watts:double weighted_average_power_w:double total_work_kj:double power_count:int
        average_cadence:int max_cadence:int calories_kcal:int relative_effort:double perceived_exertion:int
        perceived_relative_effort:int total_steps:int average_temperature_c:double weather_temperature_c:double
        apparent_temperature_c:double dewpoint_c:double humidity_fraction:double wind_speed_ms:double wind_gust_ms:double
        wind_bearing_deg:int weather_pressure_hpa:double precipitation_intensity:double precipitation_probability:double
        cloud_cover_fraction:double uv_index:double activity_gear:string commute:boolean athlete_weight_kg:double
        bike_weight_kg:double readiness_score:int readiness_level:string readiness_feedback_short:string hrv_factor_pct:int
        hrv_factor_feedback:string readiness_hrv_weekly_avg_ms:double sleep_score_factor_pct:int
        sleep_score_factor_feedback:string sleep_history_factor_pct:int sleep_history_factor_feedback:string recovery_time_h:int
        recovery_time_factor_pct:int recovery_time_factor_feedback:string acwr_factor_pct:int acwr_factor_feedback:string
        readiness_acute_load:int stress_history_factor_pct:int stress_history_factor_feedback:string valid_sleep:boolean
        sleep_score:int total_sleep_s:int deep_sleep_s:int rem_sleep_s:int light_sleep_s:int sleep_awake_s:int
        avg_sleep_stress:double body_battery_start_of_day:int body_battery_highest:int stress_avg:int stress_avg_awake:int
        hrv_ms:double hrv_status:string health_status_resting_hr_bpm:double acute_load_7d:int chronic_load_28d:int acwr:double
        acwr_status:string training_status:string fitness_level_trend:string garmin_activity_id:bigint garmin_avg_power_w:double
        garmin_norm_power_w:double aerobic_training_effect:double anaerobic_training_effect:double training_effect_label:string
        activity_training_load:double activity_body_battery_change:int is_pr:boolean hr_zone_0_s:double hr_zone_1_s:double
        hr_zone_2_s:double hr_zone_3_s:double hr_zone_4_s:double hr_zone_5_s:double hr_zone_6_s:double late_start_utc_risk:boolean
        garmin_activity_matched:boolean garmin_match_type_compatible:boolean garmin_match_start_diff_s:double distance_km:double
        average_speed_kph:double
    """,
    "fct_ride": """
        athlete_id:bigint activity_date:date activity_id:bigint started_at:timestamp_ntz activity_name:string activity_type:string
        from_upload:boolean distance_m:double elapsed_time_s:int moving_time_s:int average_speed_ms:double max_speed_ms:double
        elevation_gain_m:double elevation_loss_m:double elevation_low_m:double elevation_high_m:double max_grade_pct:double
        average_grade_pct:double average_heart_rate_bpm:int max_heart_rate_bpm:int average_watts:double
        weighted_average_power_w:double total_work_kj:double average_cadence:int max_cadence:int calories_kcal:int
        relative_effort:double perceived_exertion:int average_temperature_c:double weather_temperature_c:double
        apparent_temperature_c:double humidity_fraction:double wind_speed_ms:double wind_gust_ms:double wind_bearing_deg:int
        precipitation_intensity:double cloud_cover_fraction:double uv_index:double activity_gear:string commute:boolean
        athlete_weight_kg:double bike_weight_kg:double readiness_score:int readiness_level:string readiness_feedback_short:string
        hrv_factor_pct:int hrv_factor_feedback:string readiness_hrv_weekly_avg_ms:double sleep_score_factor_pct:int
        sleep_history_factor_pct:int recovery_time_h:int recovery_time_factor_pct:int acwr_factor_pct:int readiness_acute_load:int
        stress_history_factor_pct:int valid_sleep:boolean sleep_score:int total_sleep_s:int deep_sleep_s:int rem_sleep_s:int
        light_sleep_s:int avg_sleep_stress:double body_battery_start_of_day:int body_battery_highest:int stress_avg:int
        stress_avg_awake:int hrv_ms:double hrv_status:string health_status_resting_hr_bpm:double acute_load_7d:int
        chronic_load_28d:int acwr:double acwr_status:string training_status:string fitness_level_trend:string
        garmin_activity_id:bigint garmin_avg_power_w:double garmin_norm_power_w:double aerobic_training_effect:double
        anaerobic_training_effect:double training_effect_label:string activity_training_load:double
        activity_body_battery_change:int is_pr:boolean hr_zone_0_s:double hr_zone_1_s:double hr_zone_2_s:double hr_zone_3_s:double
        hr_zone_4_s:double hr_zone_5_s:double hr_zone_6_s:double late_start_utc_risk:boolean garmin_activity_matched:boolean
        garmin_match_type_compatible:boolean garmin_match_start_diff_s:double distance_km:double average_speed_kph:double
        average_speed_mph:double max_speed_kph:double average_wkg:double weighted_average_wkg:double watts_per_bpm:double
    """,
    "fct_run": """
        athlete_id:bigint activity_date:date activity_id:bigint started_at:timestamp_ntz activity_name:string activity_type:string
        from_upload:boolean distance_m:double elapsed_time_s:int moving_time_s:int elevation_gain_m:double elevation_loss_m:double
        elevation_low_m:double elevation_high_m:double max_grade_pct:double average_grade_pct:double
        grade_adjusted_distance_m:double average_heart_rate_bpm:int max_heart_rate_bpm:int average_cadence:int calories_kcal:int
        relative_effort:double perceived_exertion:int total_steps:int average_temperature_c:double weather_temperature_c:double
        apparent_temperature_c:double humidity_fraction:double wind_speed_ms:double wind_gust_ms:double
        precipitation_intensity:double cloud_cover_fraction:double athlete_weight_kg:double readiness_score:int
        readiness_level:string readiness_feedback_short:string hrv_factor_pct:int hrv_factor_feedback:string
        readiness_hrv_weekly_avg_ms:double sleep_score_factor_pct:int sleep_history_factor_pct:int recovery_time_h:int
        recovery_time_factor_pct:int acwr_factor_pct:int readiness_acute_load:int stress_history_factor_pct:int
        valid_sleep:boolean sleep_score:int total_sleep_s:int deep_sleep_s:int rem_sleep_s:int light_sleep_s:int
        avg_sleep_stress:double body_battery_start_of_day:int body_battery_highest:int stress_avg:int stress_avg_awake:int
        hrv_ms:double hrv_status:string health_status_resting_hr_bpm:double acute_load_7d:int chronic_load_28d:int acwr:double
        acwr_status:string training_status:string fitness_level_trend:string garmin_activity_id:bigint
        aerobic_training_effect:double anaerobic_training_effect:double training_effect_label:string activity_training_load:double
        activity_body_battery_change:int is_pr:boolean hr_zone_0_s:double hr_zone_1_s:double hr_zone_2_s:double hr_zone_3_s:double
        hr_zone_4_s:double hr_zone_5_s:double hr_zone_6_s:double late_start_utc_risk:boolean garmin_activity_matched:boolean
        garmin_match_type_compatible:boolean garmin_match_start_diff_s:double distance_km:double average_speed_kph:double
        grade_adjusted_distance_km:double pace_min_per_km:double pace_min_per_mile:double gap_min_per_km:double
        max_speed_kph:double pace_per_bpm:double
    """,
}


def columns(model: str) -> list[tuple[str, str]]:
    return [tuple(word.split(":")) for word in EXPECTED[model].split()]
