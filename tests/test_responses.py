import __spark_entry__ as E
from chalkline.plans.responses import RESPONSE_FIELDS, to_response

SF = "/root/testdata/sf0.001"


def test_response_shapes(spark):
    q = E.queries()
    chart = to_response(q["daily_activity"](spark, SF), "chartData")
    assert chart.columns == ["date", "fullDate", "views", "requests"]
    rows = chart.collect()
    assert rows[-1].fullDate == "2024-01-31" and rows[0].fullDate < rows[-1].fullDate
    recent = to_response(q["recent_requests"](spark, SF), "recentRequests").collect()
    assert recent[0].teacherId.startswith("T-") and recent[0].time >= recent[-1].time
    req = to_response(q["request_search"](spark, SF), "requestList")
    assert req.columns == list(RESPONSE_FIELDS["requestList"])
