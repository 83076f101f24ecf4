"""Explicit schemas of the files that cross the library's boundary."""

DISTRICT_POINTS = "state string, district string, latitude string, longitude string, region string"
ROSTER = "state string, district string"
WEEKLY_CSV = (
    "region string, state string, district string, week string, valid_week string, model string,"
    " precip_anom_mm_day string, t2m_anom_degC string, n_models string, init_date string, geom string"
)
ODDS_CSV = (
    "region string, state string, district string, week string, p_wetter string, p_near string, p_drier string,"
    " p_heavy string, p_dryspell string, p_hot string, n_members string, models string, init_date string"
)
SEASONAL_CSV = (
    "state string, district string, variable string, model string, lead string, valid_month string, units string,"
    " anomaly string, p_below string, p_near string, p_above string, category string, acc string"
)
OBSERVED_CSV = (
    "state string, district string, rainfall_since_june_1_pct_departure string, rainfall_last_7_days_pct_departure string,"
    " rainfall_last_14_days_pct_departure string, monsoon_onset_status string, obs_asof string"
)
ADMIN_CSV = (
    "state string, district string, forecast_date string, rainfall_since_june_1_pct_departure string,"
    " rainfall_last_7_days_pct_departure string, rainfall_last_14_days_pct_departure string, monsoon_onset_status string,"
    " week1_rainfall_signal string, week2_rainfall_signal string, week3_4_rainfall_signal string,"
    " seasonal_monsoon_context string, tmax_signal string, tmin_signal string, heat_wave_warning string,"
    " heavy_rain_warning string, humidity_heat_index_signal string, imd_source_notes string"
)
_WEEKS = "array<struct<week:int,rainfall_mm_day:double,tmax_degC:double>>"
RECORD = (
    "state string, district string, forecast_date string, rainfall_since_june_1_pct_departure int,"
    " rainfall_last_7_days_pct_departure int, rainfall_last_14_days_pct_departure int, monsoon_onset_status string,"
    " week1_rainfall_signal string, week2_rainfall_signal string, week3_4_rainfall_signal string, tmax_signal string,"
    " tmin_signal string, seasonal_monsoon_context string, heat_wave_warning boolean, heavy_rain_warning boolean,"
    " humidity_heat_index_signal string, imd_source_notes string, forecast_source string, observed_source string, "
    + ", ".join(f"week{w}_rainfall_anomaly_mm_day double, week{w}_tmax_anomaly_degC double" for w in (1, 2, 3, 4))
    + f", forecast_variants array<struct<key:string,label:string,source:string,weeks:{_WEEKS}>>,"
    " weekly_probabilities struct<n_members:bigint,models:string,init:string,source:string,weeks:array<struct<week:int,"
    "p_wetter:double,p_near:double,p_drier:double,p_heavy:double,p_dryspell:double,p_hot:double>>>"
)
_ITEMS = "array<string>"
#: Name of the older flat list of a plan (fixed by the files).
FLAT_PLAN = "icar_pdf_actions"
CONTINGENCY = (
    "state string, district string, source string, source_url string, local_sources array<string>, major_crops array<string>,"
    f" scenarios map<string,struct<crop_actions:{_ITEMS},livestock_actions:{_ITEMS},{FLAT_PLAN}:{_ITEMS},local_override_notes:array<string>>>,"
    " source_pdf string, pages int"
)
CATALOG = (
    "version int, languages map<string,string>,"
    " actions map<string,struct<source_text:string,translations:map<string,string>,status:map<string,string>>>"
)
MANIFEST = "state string, district string, filename string, source_url string, sha256 string"
GRID_LEAD = "model string, init_date date, kind string, member string, lead_hours int, lat double, lon double, t2m double, precip double"
GRID_WEEKLY = "model string, init_date date, kind string, member string, week int, lat double, lon double, t2m double, precip double"
FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
