"""Flagship audit on crafted pages, one host holding most of the pages."""
from veilscan.plans.flagship import audit_hosts


def test_audit_hosts_with_hot_host(spark):
    rows = []
    for i in range(300):   # the hot host: urgency wording and an accept button without reject
        rows.append((i, f"https://a.example/p{i}",
                     f"<html><body><p>Only {i} left today</p><button>Accept all</button></body></html>"))
    for i in range(300, 340):
        rows.append((i, f"https://b.example/p{i}",
                     '<html><body><form><input type="checkbox" name="nl" checked></form>Welcome</body></html>'))
    for i in range(340, 400):
        rows.append((i, f"http://c.example:8080/x{i}", "<html><body><p>Plain catalogue page</p></body></html>"))
    rows.append((400, "https://d.example/", None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.host: r for r in audit_hosts(pages).collect()}
    a, b, c, d = got["a.example"], got["b.example"], got["c.example"], got["d.example"]
    assert a.n_pages == 300 and a.overall_risk == "HIGH"
    assert a.patterns == "Creating Barriers|Low Stock Message"   # low message beats meso Urgency
    assert b.patterns == "Bad Defaults" and b.gdpr_concerns and b.overall_risk == "HIGH"
    assert c.pattern_count == 0 and c.overall_risk == "CLEAN"
    assert d.n_pages == 1 and d.overall_risk == "CLEAN"
