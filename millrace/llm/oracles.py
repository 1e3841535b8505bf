"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

_POOL = r"""
pool as (
  select task_id, case when f in ('musique_2hop','musique_3hop','musique_4hop','unanswerable','no_tool') then f end as task_type, difficulty, tier
  from (select *, replace(lower(trim(task_type, e' \t\r\n')), '-', '_') as f,
               row_number() over (partition by task_id order by loaded_at desc, task_type desc, difficulty desc, tier desc) as rn from task)
  where rn = 1),
"""

_CARDS = """
card as (select task_id, success, final_f1 from
  (select *, row_number() over (partition by task_id order by loaded_at desc, success desc nulls last, final_f1 desc nulls last) as rn from scorecard) where rn = 1),
ranked as (
  select t.task_id, split_part(t.task_id, '#', 1) as base_task,
    row_number() over (partition by split_part(t.task_id, '#', 1) order by coalesce(c.success, false) desc,
      case when c.final_f1 between 0 and 1 then c.final_f1 end desc nulls last, t.task_id) as rank
  from (select distinct task_id from trajectory where task_id is not null) t left join card c using (task_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with {_POOL.strip()}
            n as (select count(*) as n from pool),
            c as (select m.mix_name, m.cell_id, any_value(m.min_rows) as min_rows, any_value(m.target_share) as share,
                    any_value(floor(m.sample_share * n.n)) as size, count(p.task_id) as have
                  from mix_targets m cross join n left join pool p
                    on (m.task_type is null or m.task_type = p.task_type) and (m.difficulty is null or m.difficulty = p.difficulty) and (m.tier is null or m.tier = p.tier)
                  group by 1, 2)
            select mix_name, cell_id from c where have < greatest(min_rows, share * size)""",
        "p3_found": f"with {_CARDS} select task_id from ranked where rank > 8",
        "p3_kept": f"with {_CARDS} select base_task, task_id, cast(rank as integer) as rank from ranked where rank <= 8",
    }
