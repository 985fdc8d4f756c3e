"""What an executed plan did."""


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def broadcast_rows(df):
    """Rows of the largest table that was broadcast; runs the query."""
    df.collect()
    sizes = [0]
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "BroadcastExchangeExec":
            sizes.append(node.metrics().apply("numOutputRows").value())
    return max(sizes)


def joined_rows(df):
    """Rows that the largest join gave; runs the query."""
    df.collect()
    nodes = [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
    return max(n.metrics().apply("numOutputRows").value() for n in nodes)
