"""Saved pages of sites without an API."""

import json

from pyspark.sql import functions as F

from postlens.sources import scraped


def pages(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "page_no int, value string")


def sf_row(number, title, place="Toronto, ON", date="Jul 3, 2001"):
    return f'<tr class="data-row"><td><span><a href="/job/Toronto-{title}/{number}/" class="jobTitle-link">{title} &amp; co</a></span></td><td class="colLocation"><span class="jobLocation">\n {place} </span></td><td class="colDate"><span class="jobDate">{date}</span></td></tr>'


def test_successfactors(spark):
    one = f"<b>Results 1 – 2 of 3</b><table>{sf_row(11, 'Engineer')}{sf_row(12, 'Clerk')}</table>"
    two = f"<b>Results 3 – 3 of 3</b><table>{sf_row(13, 'Developer', 'Paris', '')}</table>"
    batch = scraped.read_scraped(pages(spark, one, two), "successfactors", "Rogers", "rogers")
    rows = {r["source_job_id"]: r for r in batch.rows.collect()}
    assert set(rows) == {"rogers:11", "rogers:12", "rogers:13"}
    r = rows["rogers:11"]
    assert (r["title"], r["raw_location"], r["source_url"], str(r["posted_at"])) == ("Engineer & co", "Toronto, ON", "https://jobs.rogers.com/job/Toronto-Engineer/11/", "2001-07-03 00:00:00")
    assert rows["rogers:13"]["posted_at"] is None
    assert tuple(batch.metrics.first()) == (3, 0, 0, True)
    detail = '<div><span itemprop="jobLocation"><span itemprop="address"><meta itemprop="addressLocality" content="Calgary"><span itemprop="addressRegion">AB</span><meta itemprop="addressCountry" content="CA"></span></span><div itemprop="description"><div>Build</div><p>things</p></div><div>foot</div></div>'
    details = spark.createDataFrame([("https://jobs.rogers.com/job/Toronto-Engineer/11/", detail), ("https://jobs.rogers.com/job/Toronto-Developer/13/", "<p>gone</p>")], "url string, value string")
    full = scraped.with_details(batch, scraped.successfactors_details(details), F.col("title").rlike("Engineer|Developer"))
    rows = {r["source_job_id"]: r for r in full.rows.collect()}
    assert set(rows) == {"rogers:11", "rogers:12"}
    assert rows["rogers:11"]["raw_description"] == "<div>Build</div><p>things</p>" and rows["rogers:11"]["raw_locations"] == ["Calgary, AB, CA"] and rows["rogers:11"]["raw_location"] == "Calgary, AB, CA"
    assert rows["rogers:12"]["raw_location"] == "Toronto, ON"
    assert tuple(full.metrics.first()) == (3, 1, 0, False)


def test_pages_that_cannot_be_judged_are_incomplete(spark):
    good = f"Results 1 – 1 of 2 {sf_row(1, 'A')}"
    for other in ("<p>no count</p>", f"Results 2 – 2 of 3 {sf_row(2, 'B')}", f"Results 2 – 2 of 2 {sf_row(1, 'A')}", 'Results 2 – 2 of 2 <tr class="data-row"><td>no link</td></tr>', "", None):
        assert scraped.read_scraped(pages(spark, good, other), "successfactors", "Rogers", "rogers").metrics.first()["fetch_complete"] is False


def test_google(spark):
    row = lambda n, extra="": f'<li class="x"><h3 class="t">Engineer {n}</h3><span class="r0wTof">Toronto, ON, Canada</span><span class="r0wTof">; Waterloo, ON</span><span class="r0wTof">+2 more</span>{extra}<a href="jobs/results/{n}-engineer?x=1&amp;y=2">go</a></li>'
    batch = scraped.read_scraped(pages(spark, f"<p>2 jobs matched</p><ul><li>menu</li>{row(71)}{row(72, '<i>Remote eligible</i>')}</ul>"), "google", "Google")
    rows = {r["source_job_id"]: r for r in batch.rows.collect()}
    assert rows["71"]["raw_locations"] == ["Toronto, ON, Canada", "Waterloo, ON"] and rows["71"]["posted_at"] is None and rows["71"]["raw_workplace_type"] is None
    assert rows["72"]["raw_workplace_type"] == "remote" and rows["72"]["source_url"] == "https://www.google.com/about/careers/applications/jobs/results/72-engineer?x=1&y=2"
    assert tuple(batch.metrics.first()) == (2, 0, 0, True)
    page = '<h3>About the job</h3><div class="a KwJkGe">Q <a href="./teams/x">t</a></div><div class="BDNOWe"><h3>Responsibilities</h3></div>'
    detail = scraped.google_details(spark.createDataFrame([("u", page), ("v", "<p>other</p>")], "url string, value string")).collect()
    assert detail[0]["raw_description"] == 'Q <a href="https://www.google.com/about/careers/applications/teams/x">t</a><h3>Responsibilities</h3>' and detail[1]["raw_description"] is None


def test_phenom(spark):
    job = {"jobSeqNo": "BELL1", "jobId": 5, "title": "Engineer; }", "description": "<p>x</p>", "location": "Montreal", "multi_location_array": [{"location": "Montreal"}, {"x": 1}], "postedDate": "2001-07-03T00:00:00.000+0000", "type": "Full"}
    other = job | {"jobId": 6, "title": "Future Opportunities", "description": "Join our Talent Community"}
    page = lambda jobs, status=200: "<script>phApp.ddo = " + json.dumps({"eagerLoadRefineSearch": {"status": status, "totalHits": len(jobs), "data": {"jobs": jobs}}}) + "; phApp.x = {};</script>"
    batch = scraped.read_scraped(pages(spark, page([job, other])), "phenom", "Bell")
    rows = {r["source_job_id"]: r for r in batch.rows.collect()}
    assert rows["bell:5"]["is_listed"] and not rows["bell:6"]["is_listed"] and rows["bell:5"]["raw_locations"] == ["Montreal"] and rows["bell:5"]["title"] == "Engineer; }"
    assert tuple(batch.metrics.first()) == (2, 0, 0, True)
    assert tuple(scraped.read_scraped(pages(spark, page([job, job | {"jobSeqNo": "a/b"}])), "phenom", "Bell").metrics.first()) == (2, 1, 0, False)
    assert scraped.read_scraped(pages(spark, page([job], 500)), "phenom", "Bell").metrics.first()["fetch_complete"] is False


def encoded(value):
    """The site's encoding: a list of values, in which objects and lists refer to others by index."""
    pool = []

    def put(v):
        at = len(pool)
        pool.append(None)
        if v is None:
            return -5
        pool[at] = {f"_{put(k)}": put(x) for k, x in v.items()} if isinstance(v, dict) else [put(x) for x in v] if isinstance(v, list) else v
        return at

    put(value)
    return f"<script>window.x.streamController.enqueue({json.dumps(json.dumps(pool))});</script>"


def test_shopify(spark):
    ident = "0a1b2c3d-0000-1111-2222-333344445555"
    post = {"id": ident, "title": "US Engineering Internships", "status": "Published", "isListed": True, "publishedDate": "2001-07-03", "locationName": "Americas", "locationIds": {"primaryLocationId": "L1", "secondaryLocationIds": ["L2", "L9"]}, "shouldDisplayCompensationOnJobBoard": True, "compensationTierSummary": "$1", "workplaceType": None}
    hidden = post | {"id": ident.replace("5555", "6666"), "isListed": False, "title": "Clerk"}
    data = {"loaderData": {"($locale)/careers": {"jobPostingsWithJobs": [{"jobPosting": post}, {"jobPosting": hidden}], "atsLocations": [{"id": "L1", "name": "Toronto"}, {"id": "L2", "externalName": "Ottawa", "name": "O"}]}}}
    batch = scraped.read_scraped(pages(spark, encoded(data)), "shopify", "Shopify")
    rows = {r["source_job_id"]: r for r in batch.rows.collect()}
    r = rows[ident]
    assert r["raw_locations"] == ["United States", "Toronto", "Ottawa"] and r["is_listed"] and json.loads(r["compensation"]) == {"compensationTierSummary": "$1"} and r["raw_workplace_type"] is None
    assert not rows[hidden["id"]]["is_listed"] and tuple(batch.metrics.first()) == (2, 0, 0, True)
    for bad in ("<script>streamController.enqueue(\"[1]\")</script>", encoded({"loaderData": {}}), "", None):
        assert scraped.read_scraped(pages(spark, bad), "shopify", "Shopify").metrics.first()["fetch_complete"] is False
