"""Explicit schemas; nothing is inferred."""

# Fixed values, from here to the end: names and types of columns, CSV headers and JSON fields must be these.

# Normalized posting, as sources deliver it.
POSTING = "ats string, external_id string, company string, title string, locations array<string>, workplace_type string, department string, url string, canonical_url string, description string, source_published_at timestamp, compensation string"

# Stored posting.
STATE = (
    "id long, ats string, board_token string, external_id string, company string, title string, normalized_title string, locations array<string>, "
    "workplace_type string, department string, url string, canonical_url string, description string, compensation string, source_published_at timestamp, "
    "first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, duplicate_of_id long, dedup_reason string, score double, skills array<string>, matched_skills array<string>"
)

INGEST_RUN = "id long, started_at timestamp, mode string, companies_requested int, companies_succeeded int, postings_fetched long, postings_new long, postings_updated long, postings_reopened long, postings_closed long, fetch_time_ms long, persist_time_ms long, wall_time_ms long"

# Raw bodies of one crawl: (ats, board, kind, offset or position, body); kind is 'board' (whole, or a part of its list
# that begins at the position in place), 'page' or 'detail', or
# 'retries' for the number of requests of a board that were repeated (in place, without a body).
RAW = "ats string, company string, board_token string, cfg_pos int, kind string, place long, item string, body string, error string"

# What each source's JSON declares; unknown fields are ignored.
GREENHOUSE = "jobs array<struct<id: long, title: string, absolute_url: string, location: struct<name: string>, departments: array<struct<name: string>>, first_published: string, updated_at: string, content: string>>"
LEVER = "array<struct<id: string, text: string, hostedUrl: string, createdAt: long, categories: struct<department: string, location: string, team: string, allLocations: array<string>>, workplaceType: string, descriptionPlain: string, lists: array<struct<text: string, content: string>>, additionalPlain: string, salaryRange: struct<currency: string, interval: string, min: double, max: double>>>"
ASHBY = "jobs array<struct<id: string, title: string, department: string, team: string, location: string, secondaryLocations: array<struct<location: string>>, isRemote: boolean, workplaceType: string, publishedAt: string, isListed: boolean, jobUrl: string, descriptionPlain: string, descriptionHtml: string, compensation: struct<compensationTierSummary: string>>>"
WORKDAY_PAGE = "total int, jobPostings array<struct<title: string, externalPath: string, locationsText: string>>"
WORKDAY_DETAIL = "jobPostingInfo struct<title: string, jobDescription: string, location: string, additionalLocations: array<string>, startDate: string, remoteType: string, externalUrl: string>"
SMART_PAGE = "totalFound int, content array<struct<id: string, name: string, releasedDate: string, location: struct<city: string, region: string, country: string, remote: boolean, hybrid: boolean, fullLocation: string>, department: struct<label: string>, function: struct<label: string>>>"
SMART_DETAIL = "postingUrl string, jobAd struct<sections: struct<companyDescription: struct<text: string>, jobDescription: struct<text: string>, qualifications: struct<text: string>, additionalInformation: struct<text: string>>>"

# Labelled pairs, as CSV.
PAIRS = ["pair_id", "stratum", "weight", "title_similarity", "company", "a_key", "a_title", "a_locations", "a_department", "a_url", "a_snippet", "b_key", "b_title", "b_locations", "b_department", "b_url", "b_snippet", "label", "note"]
