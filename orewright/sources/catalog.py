"""The sources and bronze tables that the engine knows: where files lie, what they hold, what must be true of them."""

from __future__ import annotations

from ..operators.constraints import Check, Unique, in_range, in_set
from .spec import Source, Table, table

# Column names and types of the bronze tables, in order. Lineage columns are added to each.

TRAFFIC = table(
    "bronze", "traffic_segment_hourly", unique=[Unique("segment_id", "observation_date", "hour_of_day")], checks=[Check("hour_of_day", in_range("hour_of_day", 0, 23))],
    columns="""
    segment_id text not null, observation_date date not null, hour_of_day smallint not null, avg_vehicle_count decimal(12,4), max_vehicle_count int,
    observation_count int, station_count int, min_station_quality smallint, quality_flag text, record_source text, transformed_at timestamp
    """,
)

SCHOOLS = table(
    "bronze", "school_location", unique=[Unique("school_code")],
    columns="""
    school_code int not null, age_id int, school_name text, street text, town_suburb text, postcode text, phone text, school_email text, website text,
    fax text, latest_year_enrolment_fte decimal(10,1), indigenous_pct decimal(5,2), lbote_pct decimal(5,2), icsea_value decimal(8,2),
    level_of_schooling text, selective_school text, opportunity_class boolean, school_specialty_type text, school_subtype text, preschool_ind boolean,
    distance_education text, intensive_english_centre boolean, school_gender text, late_opening_school boolean, date_1st_teacher date, lga text,
    electorate_from_2023 text, electorate_2015_2022 text, fed_electorate_from_2025 text, fed_electorate_2016_2024 text, operational_directorate text,
    principal_network text, operational_directorate_office text, operational_directorate_office_phone text, operational_directorate_office_address text,
    facs_district text, local_health_district text, aecg_region text, asgs_remoteness text, latitude decimal(12,8), longitude decimal(12,8),
    assets_unit text, sa4 text, foei_value decimal(8,2), date_extracted date, postcode_raw text, postcode_status text,
    latest_year_enrolment_fte_raw decimal(10,1), latest_year_enrolment_fte_status text, indigenous_pct_raw text, indigenous_pct_status text,
    lbote_pct_raw text, lbote_pct_status text, icsea_value_raw decimal(8,2), icsea_value_status text, opportunity_class_raw boolean,
    opportunity_class_status text, preschool_ind_raw boolean, preschool_ind_status text, distance_education_raw text, distance_education_status text,
    intensive_english_centre_raw boolean, intensive_english_centre_status text, late_opening_school_raw boolean, late_opening_school_status text,
    date_1st_teacher_raw date, date_1st_teacher_status text, latitude_raw decimal(12,8), latitude_status text, longitude_raw decimal(12,8),
    longitude_status text, foei_value_raw decimal(8,2), foei_value_status text, date_extracted_raw date, date_extracted_status text, school_id text,
    source_file text, source_row_number int, source_date date, coordinate_crs text, coordinate_status text
    """,
)

RENTS = table(
    "bronze", "rent_data", unique=[Unique("rent_id")],
    columns="""
    rent_id int not null, lga_name text, period_start date, dwelling_type text, median_weekly_rent decimal(10,2), new_bonds_count int,
    reliability_flag text
    """,
)

SALES = table(
    "bronze", "property_sales", unique=[Unique("_row_id"), Unique("source_archive", "source_file", "source_line")],
    columns="""
    _row_id bigint identity, property_id int, dealing_number text, parcel_seq smallint, version_no smallint, hashdiff text, load_from timestamp,
    last_seen timestamp, times_published int, is_current boolean, changed_fields text, district_code smallint, district_name text, contract_date date,
    settlement_date date, contract_year smallint, purchase_price bigint, area_m2 decimal(16,4), area_source text, area_type text, zoning text,
    nature_of_property text, nature_description text, primary_purpose text, strata_lot_number int, component_code text, sale_code text,
    interest_of_sale_pct smallint, property_name text, unit_number text, house_number text, street_name text, locality text, postcode text,
    flat_number text, flat_number_suffix text, number_first text, number_first_suffix text, street_name_core text, street_type_code text,
    street_suffix_code text, address_label text, legal_description text, lot text, section text, plan text, lotidstring text,
    flag_non_market_price boolean, flag_part_interest boolean, flag_has_sale_code boolean, flag_settlement_before_contract boolean, flag_bad_date boolean,
    source_archive text not null, source_file text not null, source_line int not null, parcels_in_sale smallint, flag_multi_parcel boolean,
    is_standard_sale boolean
    """,
)

STOPS = table(
    "bronze", "bus_stops", unique=[Unique("stop_id")],
    columns="""
    stop_id int not null, name text, routes_served json, geometry_type text, geometry json
    """,
)

ROUTES = table(
    "bronze", "bus_routes", unique=[Unique("_row_id")], checks=[Check("direction_id", in_set("direction_id", 0, 1))], sort=["route_id", "direction_id"],
    columns="""
    _row_id bigint identity, route_id text not null, route_short_name text, route_long_name text, agency_id int, direction_id smallint, route_color text,
    trip_headsign text, geometry_type text, geometry json
    """,
)

EDGES = table(
    "bronze", "bus_graph_edges", unique=[Unique("edge_id")], checks=[Check("direction_id", in_set("direction_id", 0, 1))],
    columns="""
    edge_id int not null, from_stop_id int, to_stop_id int, route_id text, route_short_name text, direction_id smallint,
    avg_travel_time_peak_s decimal(10,2), n_trips_peak int, avg_travel_time_offpeak_s decimal(10,2), n_trips_offpeak int, geometry_type text,
    geometry json
    """,
)

APPLICATIONS = table(
    "bronze", "da_applications", unique=[Unique("planning_portal_application_number")],
    columns="""
    planning_portal_application_number text not null, council_application_number text, council_name text, application_type text, application_status text,
    development_types text, submission_date date, lodgement_date date, determination_date date, date_last_updated timestamp, determination_authority text,
    cost_of_development decimal(16,2), number_of_new_dwellings int, number_of_storeys int, suburb text, postcode text, full_address text,
    longitude decimal(12,8), latitude decimal(12,8), assessment_exhibition_end_date timestamp, assessment_exhibition_start_date timestamp,
    number_of_existing_lots int, accompanied_by_vpa_flag boolean, development_subject_to_sic_flag boolean, epi_variation_proposed_flag boolean,
    subdivision_proposed_flag boolean, development_type_count int, location_count int, street_number1 text, street_number2 text, street_name text,
    street_type text, street_suffix text, state text, lots text, variation_to_development_standards_approved_flag boolean,
    modification_application_number text, number_of_proposed_lots int
    """,
)

# File places under the data folder, and columns that are left out on load.
SOURCES: dict[str, Source] = {
    s.name: s
    for s in (
        Source("traffic_volume", TRAFFIC, "raw/traffic_volume/traffic_segment_hourly.csv", "csv"),
        Source(
            "school_location", SCHOOLS, "raw/school_location/school_location.csv", "csv",
            drop=("nearest_station_distance_m", "station_count_300m", "nearest_station_id", "station_match_status", "station_dataset", "support_classes"),
        ),
        Source("rent_data", RENTS, "raw/rent_data/bronze_rent_data.csv", "csv", drop=("bedrooms",)),
        Source("property_sales", SALES, "raw/property_sales/sales_current.csv", "csv", drop=("load_to",)),
        Source("bus_stops", STOPS, "raw/station_stops/sydney_bus_stops.geojson", "geojson"),
        Source("bus_routes", ROUTES, "raw/station_stops/sydney_bus_routes.geojson", "geojson"),
        Source("bus_graph_edges", EDGES, "raw/gfts_historical/sydney_bus_graph_edges.geojson", "geojson"),
        Source("da_applications", APPLICATIONS, "raw/da_applications/nsw_da_greater_applications.csv", "csv"),
    )
}

TABLES: dict[str, Table] = {s.table.name: s.table for s in SOURCES.values()}
